"""Chat formatting over a prefix tree of conversations.

Every turn becomes a fragment of text.  A conversation's path is the chain of its turns' hashes, each over the one before
and its own fragment, so conversations with the same first turns have paths with the same beginning.  Distinct paths are
sorted; the turns that a path does not share with the one before it are new, and they are emitted as one segment.  So every
node of the tree is emitted once, in depth-first order, and a segment carries

* its place in the emitted stream,
* the position of its first token in any conversation through it: the length of its ancestors,
* the stream intervals of its ancestors, which with the segment's own beginning are all that its tokens may attend to;
  each is a beginning of another segment,
* its turns, each with the part of its fragment under the loss mask (an assistant's text).

The sort is a range partitioning, and each partition takes one pass; what its first conversation shares with earlier
partitions is put in from one row per partition.  So work and space grow with the text and with the places where
conversations part, never with the square of a conversation's turns.  A token is a code point.

Template: `<turn role="ROLE">TEXT</turn>` and a line end.  In roles and texts a backslash becomes `\\e`, `<` becomes
`\\l`, `>` becomes `\\g`; so no text can hold a control string, and reading back loses nothing.

Defined edge cases: a null text or role counts as empty; turns are ordered by number, then role, then text, null
numbers first; repeated rows are repeated turns; a null conv_id is a conversation of its own; equal conversations
share all nodes; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, spread_join, table, written

OPEN, CLOSE = '<turn role="', "</turn>\n"
LOSS_ROLE = "assistant"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))
#: Bytes of a node's name in a path.
NAME = 16
_INTERVALS = "array<struct<start:bigint,end:bigint>>"


def escaped(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, leaf (the name of its last node), path (the names of all, joined), x: fragment, loss_start, loss_length of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.struct("turn", role, text).alias("t"))

    def turn(t: Column) -> Column:
        def made(head: Column, body: Column) -> Column:
            masked = F.when(t["role"] == LOSS_ROLE, F.length(body)).otherwise(0)
            return F.struct(F.concat(head, body, F.lit(CLOSE)).alias("fragment"), F.length(head).alias("loss_start"), masked.alias("loss_length"))

        return let(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit('">')), lambda head: let(escaped(t["text"]), lambda body: made(head, body)))

    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", turn).alias("x"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, paths = batch.column("x"), []
            ends = (x.offsets.to_numpy() - x.offsets[0].as_py()).tolist()
            fragments = x.flatten().field("fragment").to_pylist()
            for a, b in zip(ends, ends[1:]):
                names = accumulate(fragments[a:b], lambda name, f: md5(name + f.encode()).digest(), initial=b"")
                paths.append(b"".join(names))
            leaves = [p[-NAME:] for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(leaves, pa.binary()), pa.array(paths, pa.binary()), x], names=["conv_id", "leaf", "path", "x"])

    id_type = conversations.schema["conv_id"].dataType.simpleString()
    return convs.mapInArrow(chained, f"conv_id {id_type}, leaf binary, path binary, x array<struct<fragment:string,loss_start:int,loss_length:int>>")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first names two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // NAME
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // NAME


def local_segments(ordered: DataFrame) -> DataFrame:
    """Each path's segment, with places counted from the beginning of its part.

    ordered: part, path, x.  `held` is the length of what is shared with earlier parts, whose intervals are not in `ancestors`.
    The last path of the part before stands first in a part and is no path of it.
    """
    ends = ordered.groupBy("part").agg(F.max("path").alias("last"))
    before = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("path")).where("path is not null")
    guests = before.select("part", "path", F.lit(None).cast(ordered.schema["x"].dataType).alias("x"))
    rows = ordered.select("part", "path", "x").unionByName(guests).repartition("part").sortWithinPartitions("part", "path")
    schema = f"part int, leaf binary, local long, held long, ancestors {_INTERVALS}, depth int, position long, length long, turns array<struct<at:bigint,fragment:string,loss_start:int,loss_length:int>>"
    fields = pa.schema([
        ("part", pa.int32()), ("leaf", pa.binary()), ("local", pa.int64()), ("held", pa.int64()), ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("depth", pa.int32()), ("position", pa.int64()), ("length", pa.int64()),
        ("turns", pa.list_(pa.struct([("at", pa.int64()), ("fragment", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32())]))),
    ])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, stack, inherited = None, b"", 0, [], 0
        for batch in batches:
            out = []
            for k in range(len(batch)):
                p, path, x = (batch.column(c)[k].as_py() for c in ("part", "path", "x"))
                if p != part:
                    part, last, at, stack, inherited = p, b"", 0, [], 0
                if x is None:
                    last, inherited = path, len(path) // NAME
                    continue
                same = shared_turns(last, path)
                sums = [0, *accumulate(len(t["fragment"]) for t in x)]
                # where the segments on this path begin, and their first turn and the one after their last
                stack = [(start, a, min(b, same)) for start, a, b in stack if a < same]
                inherited = min(inherited, same)
                ancestors = [{"start": start, "end": start + sums[b] - sums[a]} for start, a, b in stack]
                turns = [t | {"at": s - sums[same]} for t, s in zip(x[same:], sums[same:])]
                length = sums[-1] - sums[same]
                out.append({"part": part, "leaf": path[-NAME:], "local": at, "held": sums[inherited], "ancestors": ancestors, "depth": same, "position": sums[same], "length": length, "turns": turns})
                stack.append((at, same, len(x)))
                last, at = path, at + length
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.mapInArrow(emitted, schema)


def carried(segments: DataFrame) -> DataFrame:
    """part, base (its place in the stream), path: the intervals of the last path before it, each with the length before it.

    One row per part meets in one task.
    """
    last = F.max_by(F.struct("local", "length", "held", "ancestors"), "local")
    ends = segments.groupBy("part").agg(F.sum("length").alias("total"), last.alias("last"))
    fields = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("path", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, path = 0, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                befores = [0, *accumulate(e - s for s, e in path)]
                out.append({"part": row["part"], "base": base, "path": [{"start": s, "end": e, "before": b} for (s, e), b in zip(path, befores)]})
                held, own = row["last"]["held"], row["last"]
                path = [(s, min(e, s + held - b)) for (s, e), b in zip(path, befores) if b < held]
                path += [(base + a["start"], base + a["end"]) for a in own["ancestors"]]
                path.append((base + own["local"], base + own["local"] + own["length"]))
                base += row["total"]
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return ends.repartition(1).sortWithinPartitions("part").mapInArrow(run, "part int, base long, path array<struct<start:bigint,end:bigint,before:bigint>>")


def prefix_tree(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per segment: leaf, depth, position, start, length, ancestors (start, end), turns (at, fragment, loss_start, loss_length).

    depth counts the turns before it; `at` is a turn's place in its segment; leaf names the conversations that end with it.
    """
    distinct = paths.groupBy("leaf").agg(F.first("path").alias("path"), F.first("x").alias("x"))
    ranged = distinct.repartitionByRange(parts, "path") if parts else distinct.repartitionByRange("path")
    ordered = written(ranged.select(F.spark_partition_id().alias("part"), "path", "x"), "ordered")
    segments = written(local_segments(ordered), "segments")
    rows = segments.join(carried(segments), "part")
    held = F.filter("path", lambda a: a["before"] < F.col("held"))
    held = F.transform(held, lambda a: F.struct(a["start"].alias("start"), F.least(a["end"], a["start"] + F.col("held") - a["before"]).alias("end")))
    own = F.transform("ancestors", lambda a: F.struct((a["start"] + F.col("base")).alias("start"), (a["end"] + F.col("base")).alias("end")))
    return rows.select("leaf", "depth", "position", (F.col("base") + F.col("local")).alias("start"), "length", F.concat(held, own).alias("ancestors"), "turns")


def format_chats(conversations: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The emitted tree, a row per segment, and conv_id, leaf: the segment that each conversation ends with."""
    paths = written(turn_paths(conversations), "paths")
    return written(prefix_tree(paths, parts), "tree"), paths.select("conv_id", "leaf")


def conversations_of(tree: DataFrame) -> DataFrame:
    """leaf, formatted, turns (role, text), loss (texts under the mask), put together from the emitted intervals."""
    own = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    spans = tree.select("leaf", F.posexplode(F.concat("ancestors", F.array(own))).alias("i", "a")).select("leaf", "i", "a.start", (F.col("a.end") - F.col("a.start")).alias("taken"))
    pieces = spread_join(spans, tree.select("start", "turns"), "start")
    pieces = pieces.select("leaf", F.struct("i", F.filter("turns", lambda t: t["at"] < F.col("taken")).alias("turns")).alias("x"))
    whole = pieces.groupBy("leaf").agg(F.sort_array(F.collect_list("x")).alias("x")).select("leaf", F.flatten("x.turns").alias("x"))
    parts = F.filter(F.split("formatted", CLOSE), lambda t: F.length(t) > 0)
    turns = F.transform("parts", lambda t: F.struct(
        unescaped(F.regexp_extract(t, '(?s)^<turn role="([^>]*)">', 1)).alias("role"),
        unescaped(F.regexp_replace(t, '(?s)^<turn role="[^>]*">', "")).alias("text"),
    ))
    loss = F.transform(F.filter("x", lambda t: t["loss_length"] > 0), lambda t: unescaped(F.substring(t["fragment"], t["loss_start"] + 1, t["loss_length"])))
    out = whole.select("leaf", F.array_join("x.fragment", "").alias("formatted"), loss.alias("loss")).withColumn("parts", parts)
    return out.select("leaf", "formatted", turns.alias("turns"), "loss")


def read_back(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss (texts under the mask) of every conversation."""
    return spread_join(leaves, conversations_of(tree), "leaf").drop("leaf")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    tree, leaves = format_chats(rows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    # equal conversations have one leaf, so each text is put together and hashed once
    found = conversations_of(tree).select("leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    return spread_join(leaves, found, "leaf").drop("leaf")


#: The same figures straight from the table; the escapes add one character to each backslash and angle bracket.
OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum(22 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) as formatted_chars
  from t group by conv_id
)
select conv_id, n_turns, sha256(told) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from g
"""
