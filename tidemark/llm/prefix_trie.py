"""Prefix trie of conversations: one row for every distinct beginning, with figures of its subtree.

A conversation is the chain of its turns' hashes, each over the one before, so that conversations with the same first turns
have paths with the same beginning.  Distinct paths are sorted and cut into blocks.

* In a block one pass over the longest common prefixes (LCP) of neighbours, with a stack, finds for each node the nearest
  smaller LCP on both sides, and so its interval of paths: this is the Cartesian tree of the LCP array.  Equal LCPs are one
  node, and a path pushes a node for each depth that its LCP with the one before leaves open.  A node is closed where a
  smaller LCP comes; its figures then go to its parent.
* A node on a block's first or last path may go on in the blocks beside it.  Such nodes leave the block as fragments: what
  the block's least LCP (its minimum) keeps open to the left, and what is open at its end.  One pass with the same stack over
  the fragments of all blocks closes them.  There are at most two paths of fragments a block, so this pass takes
  depth x blocks small rows, whatever the number of conversations, and holds one path.

Texts are hashed and measured before anything is gathered: a turn is 20 bytes and its order.  A conversation's turns are one row.
The digest of the members that end at a node takes its ids in order, in pieces of at most ID_RANGE ids.

Defined edge cases: a null role or text is empty; turns with the same number go by role, then by the hash of their texts, null
numbers first; repeated rows are repeated turns; rows without conv_id belong to no conversation and are left out; a
conversation whose turns all go is a member of the root; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import NAME, shared_turns
from .common import spread_join, table, written

#: Conversations that begin alike: those of one hundred, and by how many turns at most.
FAMILY, HEADS = 100, 6
#: Ids that one piece of a node's digest spans.
ID_RANGE = 4096
_NODE = "name binary, parent binary, depth long, n long, least long, leaves long, children long, saved long, chars long"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (hash, chars) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    named = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), named.alias("hash"), F.length(text).alias("chars")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["hash"].alias("hash"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation with its family's first turns in place of its own."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    heads = lists.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("turns", F.lit(1), F.lit(HEADS - 1)).alias("head"))
    rows = rows.join(heads, "first", "left")
    none = F.slice("turns", F.lit(1), F.lit(0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the names of its nodes below the root, joined), chars (of each turn's text); conversations: conv_id, turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, out = batch.column("turns"), []
            flat = turns.flatten()
            ends = (turns.offsets.to_numpy() - turns.offsets[0].as_py()).tolist()
            hashes = flat.field("hash").to_pylist()
            for a, b in zip(ends, ends[1:]):
                out.append(b"".join(accumulate(hashes[a:b], lambda name, h: hashlib.md5(name + h).digest(), initial=b"")))
            chars = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field("chars").cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.binary()), chars], names=["conv_id", "path", "chars"])

    return conversations.mapInArrow(run, "conv_id long, path binary, chars array<long>")


class _Stack:
    """The open path of a pass over sorted paths.  A node: name, depth, n, least, leaves, children, saved, chars."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.closed: list[tuple] = []

    def push(self, name: bytes, chars: int) -> None:
        self.nodes.append([name, len(self.nodes), 0, None, 0, 0, 0, chars])

    def add(self, level: int, n: int, least: int | None, leaves: int = 0, children: int = 0, saved: int = 0) -> None:
        x = self.nodes[level]
        x[2] += n
        x[3] = least if x[3] is None else x[3] if least is None else min(x[3], least)
        x[4] += leaves
        x[5] += children
        x[6] += saved

    def close(self, depth: int) -> None:
        """Close the nodes below this depth; what they hold goes to their parents."""
        while len(self.nodes) > depth + 1:
            name, at, n, least, leaves, children, saved, chars = self.nodes.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * chars
            parent = self.nodes[-1][0] if self.nodes else None
            self.closed.append((name, parent, at, n, least, leaves, children, saved, chars))
            if self.nodes:
                self.add(len(self.nodes) - 1, n, least, leaves, 1, saved)

    def taken(self) -> list[dict]:
        keys = ("name", "parent", "depth", "n", "least", "leaves", "children", "saved", "chars")
        out, self.closed = [dict(zip(keys, x)) for x in self.closed], []
        return out


_FIELDS = [("name", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "n", "least", "leaves", "children", "saved", "chars")]]


def block_nodes(ordered: DataFrame) -> DataFrame:
    """The closed nodes of each block (place null), and its fragments in order of place; ordered: block, path, chars, n, least."""
    schema = pa.schema([("block", pa.int32()), ("place", pa.int64()), *_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, block, last, shared = _Stack(), None, b"", 0

        def fragments(down_to: int) -> list[dict]:
            """The open nodes from this depth on, as they are."""
            keys = ("name", "depth", "n", "least", "leaves", "children", "saved", "chars")
            out = [dict(zip(keys, x)) | {"block": block} for x in stack.nodes[down_to:]]
            del stack.nodes[down_to:]
            return out

        held: list[dict] = []  # fragments of the first path, deepest last; they leave when the block ends
        for batch in batches:
            out: list[dict] = []
            for b, path, chars, n, least in zip(*(batch.column(c).to_pylist() for c in ("block", "path", "chars", "n", "least"))):
                if b != block:
                    if block is not None:
                        out += _ended(held, fragments(0), shared)
                    stack, block, last, held = _Stack(), b, b"", []
                    stack.push(b"", 0)
                    same, shared = 0, len(path) // NAME
                else:
                    same = shared_turns(last, path)
                    stack.close(max(same, shared))
                    if same < shared:  # what remains of the first path's lower nodes is final for this block
                        held += fragments(same + 1)
                        shared = same
                    out += [x | {"block": b, "place": None} for x in stack.taken()]
                for d in range(same, len(path) // NAME):
                    stack.push(path[d * NAME : (d + 1) * NAME], chars[d])
                stack.add(len(path) // NAME, n, least)
                last = path
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if block is not None:
            yield pa.RecordBatch.from_pylist(_ended(held, fragments(0), shared), schema=schema)

    return ordered.mapInArrow(run, "block int, place long, " + _NODE)


def _ended(first: list[dict], rest: list[dict], shared: int) -> list[dict]:
    """All fragments of a block: its first path from the root down, then what its last path does not share with that."""
    out = rest[: shared + 1] + sorted(first, key=lambda x: x["depth"]) + rest[shared + 1 :]
    return [x | {"place": i} for i, x in enumerate(out)]


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """The nodes that the fragments of all blocks make up; they are few, and one task takes them in order."""
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack()
        for batch in batches:
            for x in batch.to_pylist():
                depth = x["depth"]
                if depth < len(stack.nodes) and stack.nodes[depth][0] != x["name"]:
                    stack.close(depth - 1)
                if depth == len(stack.nodes):
                    stack.push(x["name"], x["chars"])
                stack.add(depth, x["n"], x["least"], x["leaves"], x["children"], x["saved"])
            yield pa.RecordBatch.from_pylist(stack.taken(), schema=schema)
        stack.close(-1)
        yield pa.RecordBatch.from_pylist(stack.taken(), schema=schema)

    columns = [c for c, _ in _FIELDS if c != "parent"]
    return fragments.select("block", "place", *columns).repartition(1).sortWithinPartitions("block", "place").mapInArrow(run, _NODE)


def digests(members: DataFrame) -> DataFrame:
    """name, ends_sha256 of every node at which a conversation ends; members: name, conv_id."""
    part = F.floor(F.col("conv_id") / ID_RANGE)
    pieces = members.groupBy("name", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            out = []
            for x, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if x != name:
                    if digest:
                        out.append((name, digest.hexdigest()))
                    name, digest = x, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["name", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])

    return pieces.repartition("name").sortWithinPartitions("name", "part").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per node: name, parent (names), depth, n, least, leaves, children, saved; conversations: conv_id, path, chars."""
    distinct = conversations.groupBy("path").agg(F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ranged = distinct.repartitionByRange(blocks, "path") if blocks else distinct.repartitionByRange("path")
    ordered = written(ranged.sortWithinPartitions("path").select(F.spark_partition_id().alias("block"), "path", "chars", "n", "least"), "ordered")
    nodes = written(block_nodes(ordered.repartition("block").sortWithinPartitions("block", "path")), "nodes")
    columns = [c for c, _ in _FIELDS]
    return written(nodes.where("place is null").select(*columns).unionByName(joined_fragments(nodes.where("place is not null")).select(*columns)), "trie")


def trie_of(conversations: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    whole = written(paths(rebuilt(written(turn_lists(conversations), "turns"))), "paths")
    nodes = prefix_trie(whole, blocks)
    ends = digests(whole.select(F.substring("path", -NAME, NAME).alias("name"), "conv_id"))
    above = nodes.select(F.col("name").alias("parent"), F.col("least").alias("parent_conv_id"))
    low = spread_join(nodes.where("parent is not null"), above, "parent").select("name", "least", "depth", "parent_conv_id", "n", "children", "leaves", "saved")
    top = nodes.where("parent is null").select("name", "least", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n", "children", "leaves", "saved")
    rows = low.unionByName(top).join(ends, "name", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The same by prefixes as text keys.  crc32 is taken bit by bit over the decimal digits; a subtree's sum goes over all beginnings of its nodes.
OP13_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), own as (
  select conv_id, list({'k': md5(length(role) || ' ' || role || text), 'n': length(text)} order by turn nulls first, role, md5(length(role) || ' ' || role || text)) as turns
  from t group by conv_id
), crc as (
  select conv_id, turns, (xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce([xor(c, b)] || [0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint],
      lambda v, i: xor(v >> 1, (v & 1) * 3988292384::bigint))), 4294967295::bigint) % 6)::int as h
  from own
), built as (
  select c.conv_id, coalesce(f.turns[1:c.h], []) || c.turns[c.h + 1:] as turns
  from crc c left join own f on f.conv_id = c.conv_id - c.conv_id % 100
), member as (
  select conv_id, len(turns) as size, d::bigint as depth, array_to_string(list_transform(turns[1:d], lambda x: x.k), '') as key, case when d = 0 then 0 else turns[d].n end as chars
  from built, lateral (select unnest(range(0, len(turns) + 1)) as d)
), node as (
  select key, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256
  from member group by key, depth
), child as (
  select substr(key, 1, (32 * (depth - 1))::bigint) as key, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2
), flat as (
  select node.*, coalesce(child.n, 0) as n_children from node left join child using (key, depth)
), below as (
  select substr(key, 1, (32 * d)::bigint) as key, d::bigint as depth, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves
  from flat, lateral (select unnest(range(0, depth + 1)) as d) group by 1, 2
)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens::bigint as saved_tokens, f.ends_sha256
from flat f join below using (key, depth) left join flat p on p.depth = f.depth - 1 and p.key = substr(f.key, 1, (32 * (f.depth - 1))::bigint)
"""
