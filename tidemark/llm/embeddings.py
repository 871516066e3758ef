"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors are compared inside groups: equal label, equal number of components.  A link is a cosine of COSINE or more.

* Balls: vectors within half the link's angle of one pivot are all linked to each other, so a ball stands for all of them
  and its inner links are counted, not listed.  Pivots are the least of their cell of random half-spaces, first in coarse
  cells, which hold the large groups of copies together, then in finer ones.  A vector that finds no pivot is a ball of
  its own.
* Collisions: every table has one random projection, sorted inside cells of a few half-spaces, so that a window holds few
  balls whatever the number of vectors.  A ball is the interval of its members' projections.  Two balls collide in a table
  where some member of one lies in the window of WINDOW around some member of the other.
* Count: a pair of balls passes with COLLISIONS colliding tables.  The number of tables is calibrated: two vectors at the
  threshold agree on a half-space with probability 1 - angle / pi, and in the window with that of a normal variable; so a
  binomial sum gives the tables with which such a pair passes with a probability of RECALL or more.  Closer pairs pass
  more surely.
* Verification: two centres and radii tell most pairs of balls apart: all members linked, or none.  The rest is counted
  exactly, in blocks of members, in double precision.

Work grows with the number of vectors times the number of tables, and that with some n ** 0.2.

Defined edge cases: a vector that is null, empty, zero, holds null or non-finite components, or has a null label links with
nothing and is a component of its own; repeated rows are vectors like others and link with each other; a null id counts as
a link of others but never names a component, unless no id does; such a row is never kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread_join, table, written
from .components import components

COSINE = 0.93
RECALL = 0.98
COLLISIONS = 2
ANGLE = math.acos(COSINE)
#: Half the width of a window: twice the distance of two unit vectors at the threshold.
WINDOW = 2 * math.sqrt(2 - 2 * COSINE)
#: Vectors that a cell holds on average, in a group of the largest size.
CELL = 8
#: Width of the slices that a sorted projection is dealt out by.
SLICE = 2 * WINDOW
#: Members of a ball that are compared at once.
BLOCK = 512
#: What rounding may do to an angle; pairs nearer to a bound than this are compared exactly.
SLACK = 1e-6


def collision_chance(half_spaces: int) -> float:
    """Of two vectors at the threshold, in one table."""
    return (1 - ANGLE / math.pi) ** half_spaces * math.erf(WINDOW / math.sqrt(2 - 2 * COSINE) / math.sqrt(2))


def tables_for(half_spaces: int) -> int:
    """The least number of tables in which two vectors at the threshold collide COLLISIONS times with chance RECALL."""
    q = collision_chance(half_spaces)
    missed = lambda n: sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(COLLISIONS))
    low, high = COLLISIONS, COLLISIONS
    while missed(high) > 1 - RECALL:
        low, high = high, 2 * high
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if missed(mid) > 1 - RECALL else (low, mid)
    return high


@lru_cache(maxsize=4096)
def _normals(kind: int, number: int, dim: int, columns: int) -> np.ndarray:
    """dim x columns of normal variables, the same on every machine; whole vectors of a table at a time."""
    return np.random.Generator(np.random.PCG64([kind, number, dim])).standard_normal((columns, dim)).T


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _by_dim(whole: pa.RecordBatch, vector: str = "unit") -> Iterator[pa.RecordBatch]:
    """The batch in parts of some megabytes, all vectors of a part with the same number of components."""
    for batch in slices([whole], vector):
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            yield batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def _cells(x: np.ndarray, kind: int, number: int, half_spaces: int) -> np.ndarray:
    bits = x @ _normals(kind, number, x.shape[1], max(half_spaces, 1))[:, :half_spaces] > 0
    return bits @ (np.int64(1) << np.arange(half_spaces, dtype=np.int64)) if half_spaces else np.zeros(len(x), np.int64)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, grp (label, dim), dim, unit (float64 bytes; null for a vector that links with nothing)."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, known = batch.column("embedding"), batch.column("label").is_valid().to_pylist()
            offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            dims, units = [], []
            for a, b, real in zip(offsets, offsets[1:], map(all, zip(valid, known))):
                x = lists.values.slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is no number
                fine = real and len(x) and np.isfinite(x).all() and x.any()
                if fine:
                    x = x / np.abs(x).max()  # so that no square is lost or overflows
                    x = x / math.sqrt(x @ x)
                dims.append(len(x))
                units.append(x.tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])

    rows = vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, unit binary")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.struct("label", "dim").alias("grp"), "dim", "unit")


def balls(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Members of balls of several (row, grp, dim, unit, ball: its pivot's row), and the rows left; most: rows of the largest group."""
    bits = max(1, math.ceil(math.log2(max(most, 2))))
    left, gathered = rows, None
    for number, half_spaces in enumerate((bits // 3, 2 * bits // 3, bits, bits)):

        def celled(batches: Iterator[pa.RecordBatch], number=number, half_spaces=half_spaces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _by_dim(batch):
                    yield part.append_column("c", pa.array(_cells(_matrix(part.column("unit")), 0, number, half_spaces)))

        kind = left.schema["grp"].dataType.simpleString()
        cells = left.mapInArrow(celled, f"row long, grp {kind}, dim int, unit binary, c long").select("row", "grp", "dim", "unit", F.struct("grp", "c").alias("cell"))
        cells = written(cells, "cells")
        pivots = cells.groupBy("cell").agg(F.min(F.struct(F.xxhash64("row"), "row", "unit")).alias("p"), F.count("*").alias("n")).where("n > 1")
        met = spread_join(cells, pivots.select("cell", F.col("p.row").alias("pivot"), F.col("p.unit").alias("other")), "cell")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _by_dim(batch):
                    cosines = np.einsum("ij,ij->i", _matrix(part.column("unit")), _matrix(part.column("other")))
                    yield part.filter(pa.array(cosines >= math.cos(ANGLE / 2 - SLACK))).select(["row", "pivot"])

        joined = written(met.select("row", "dim", "unit", "pivot", "other").mapInArrow(near, "row long, pivot long"), "joined")
        # a pivot that met no other stays for the next round
        several = joined.where("row <> pivot").select("pivot").distinct()
        joined = joined.join(several, "pivot", "left_semi")
        joined = written(joined.select("row", F.col("pivot").alias("ball")), "joined")
        found = left.join(joined, "row")
        gathered = found if gathered is None else gathered.unionByName(found)
        left = written(left.join(joined, "row", "left_anti"), "left")
    return written(gathered, "gathered"), left


def centred(members: DataFrame) -> DataFrame:
    """ball, grp, dim, size, centre, radius (an angle) of balls of several members."""
    kind = members.schema["grp"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch):
                x = _matrix(part.column("unit"))
                ball, first, at = np.unique(part.column("ball").to_numpy(), return_index=True, return_inverse=True)
                total = np.zeros((len(ball), x.shape[1]))
                np.add.at(total, at, x)
                grp = part.column("grp").take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array(ball), grp, part.column("dim").take(pa.array(first)), pa.array(np.bincount(at)), pa.array([v.tobytes() for v in total], pa.binary())], names=["ball", "grp", "dim", "n", "total"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for totals in batch.column("totals").to_pylist():
                x = np.sum([np.frombuffer(t, np.float64) for t in totals], axis=0)
                out.append((x / math.sqrt(x @ x)).tobytes())
            yield batch.drop_columns(["totals"]).append_column("centre", pa.array(out, pa.binary()))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch):
                cosines = np.einsum("ij,ij->i", _matrix(part.column("unit")), _matrix(part.column("centre")))
                yield pa.RecordBatch.from_arrays([part.column("ball"), pa.array(np.arccos(np.clip(cosines, -1, 1)))], names=["ball", "angle"])

    # a ball has a partial sum for each batch at most
    sums = members.select("ball", "grp", "dim", "unit").mapInArrow(partial, f"ball long, grp {kind}, dim int, n long, total binary")
    sums = sums.groupBy("ball").agg(F.first("grp").alias("grp"), F.first("dim").alias("dim"), F.sum("n").alias("size"), F.collect_list("total").alias("totals"))
    centres = written(sums.mapInArrow(whole, f"ball long, grp {kind}, dim int, size long, centre binary"), "centres")
    met = spread_join(members.select("ball", "dim", "unit"), centres.select("ball", "centre"), "ball")
    radii = met.mapInArrow(away, "ball long, angle double").groupBy("ball").agg(F.max("angle").alias("radius"))
    return centres.join(radii, "ball")


def collisions(several: DataFrame, single: DataFrame, half_spaces: int) -> DataFrame:
    """Pairs of balls (a, b) that collide in COLLISIONS tables or more; rows: ball, grp, dim, unit of every member."""
    tables = tables_for(half_spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch):
                x = _matrix(part.column("unit"))
                cells, places = np.empty((len(x), tables), np.int64), np.empty((len(x), tables))
                for t in range(tables):
                    cells[:, t] = _cells(x, 1, t, half_spaces)
                    places[:, t] = (x @ _normals(2, t, x.shape[1], 1))[:, 0]
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, tables), pa.int32()), pa.array(v.ravel(), t))
                yield pa.RecordBatch.from_arrays([part.column("ball"), part.column("grp"), lists(cells, pa.int64()), lists(places, pa.float64())], names=["ball", "grp", "cells", "places"])

    def entries(members: DataFrame) -> DataFrame:
        kind = members.schema["grp"].dataType.simpleString()
        out = members.select("ball", "grp", "dim", "unit").mapInArrow(run, f"ball long, grp {kind}, cells array<long>, places array<double>")
        out = out.select("ball", F.xxhash64("grp").alias("g"), F.posexplode(F.arrays_zip("cells", "places")).alias("t", "x"))
        return out.select("ball", F.xxhash64("g", "t", "x.cells").alias("key"), F.col("x.places").alias("place"))

    intervals = entries(several).groupBy("key", "ball").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    intervals = written(intervals.unionByName(entries(single).select("key", "ball", F.col("place").alias("low"), F.col("place").alias("high"))), "intervals")
    slice_of = lambda c: F.floor(c / SLICE)
    x = intervals.select("key", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high") + WINDOW))).alias("slice"), F.col("ball").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    y = intervals.select("key", slice_of(F.col("low")).alias("slice"), F.col("ball").alias("b"), F.col("low").alias("low_b"))
    later = (F.col("low_b") > F.col("low_a")) | ((F.col("low_b") == F.col("low_a")) & (F.col("b") > F.col("a")))
    met = x.join(y, ["key", "slice"]).where(later & (F.col("low_b") <= F.col("high_a") + WINDOW))
    met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= COLLISIONS).select("a", "b")


def resolved(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b, size_a, size_b, whole of the pairs that may be linked: whole where all members are; held: balls."""
    side = lambda s: held.select(F.col("ball").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("grp", "dim", "size", "centre", "radius")])
    rows = spread_join(spread_join(pairs, side("a"), "a"), side("b"), "b").where(F.col("grp_a").eqNullSafe(F.col("grp_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, "centre_a"):
                cosines = np.einsum("ij,ij->i", _matrix(part.column("centre_a")), _matrix(part.column("centre_b")))
                wide = part.column("radius_a").to_numpy() + part.column("radius_b").to_numpy()
                angle = np.arccos(np.clip(cosines, -1, 1))
                points = (part.column("size_a").to_numpy() == 1) & (part.column("size_b").to_numpy() == 1)
                whole = np.where(points, cosines >= COSINE, angle + wide <= ANGLE - SLACK)
                maybe = np.where(points, whole, angle - wide <= ANGLE + SLACK)
                out = part.select(["a", "b", "size_a", "size_b"]).append_column("whole", pa.array(whole))
                yield out.filter(pa.array(maybe))

    rows = rows.select("a", "b", "size_a", "size_b", F.col("dim_a").alias("dim"), "centre_a", "centre_b", "radius_a", "radius_b")
    return rows.mapInArrow(run, "a long, b long, size_a long, size_b long, whole boolean")


def counted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, row, n: the exact number of b's members linked to each of a's, and the other way round; none where 0.

    Blocks of members meet, not members; no pair of members is a row.
    """
    asked = pairs.select(F.col("a").alias("ball"), F.col("size_a").alias("size")).union(pairs.select("b", "size_b")).distinct()
    rows = spread_join(members.select("ball", "row", "unit"), asked, "ball")
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)).alias("block")
    blocks = written(rows.groupBy("ball", block).agg(F.collect_list(F.struct("row", "unit")).alias("x")), "blocks")
    side = lambda s: blocks.select(F.col("ball").alias(s), F.col("x").alias(f"x_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = (batch.column(c)[k].values for c in ("x_a", "x_b"))
                linked = _matrix(x.field("unit")) @ _matrix(y.field("unit")).T >= COSINE
                for side, n in ((x, linked.sum(1)), (y, linked.sum(0))):
                    some = n > 0
                    out = [pa.array(side.field("row").to_numpy()[some]), pa.array(n[some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(c)[k], int(some.sum())) for c in ("a", "b")] + out, names=["a", "b", "row", "n"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "x_a", "x_b").repartition("a", "b").mapInArrow(run, "a long, b long, row long, n long")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of vectors (vec_id, label, embedding)."""
    every = written(unit_vectors(vectors), "units")
    rows = every.where("unit is not null").select("row", "grp", "dim", "unit")
    most = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 1
    several, left = balls(rows, most)
    single = left.withColumn("ball", F.col("row"))
    held = centred(several).unionByName(single.select("ball", "grp", "dim", F.lit(1).cast("long").alias("size"), F.col("unit").alias("centre"), F.lit(0.0).alias("radius")))
    held = written(held.select("ball", "grp", "dim", "size", "centre", "radius"), "balls")
    half_spaces = max(0, math.ceil(math.log2(most / CELL)))
    pairs = written(resolved(written(collisions(several, single, half_spaces), "pairs"), held), "resolved")
    members = several.select("row", "ball", "unit").unionByName(single.select("row", "ball", "unit"))
    exact = written(counted(pairs.where("not whole"), members), "exact")

    whole = pairs.where("whole")
    outer = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).union(whole.select("b", "size_a")).groupBy("ball").agg(F.sum("n").alias("outer"))
    labels = components(whole.select("a", "b").union(exact.select("a", "b").distinct()))
    facts = held.select("ball", "size").join(outer, "ball", "left").join(labels.withColumnRenamed("node", "ball"), "ball", "left")
    facts = written(facts.select("ball", (F.col("size") - 1 + F.coalesce("outer", F.lit(0))).alias("inner"), F.coalesce("label", "ball").alias("class")), "facts")
    named = spread_join(members.select("row", "ball"), facts, "ball").select("row", "inner", "class")
    named = named.join(exact.groupBy("row").agg(F.sum("n").alias("more")), "row", "left")
    out = every.select("row", "vec_id").join(named, "row", "left")
    # a row that links with nothing is a class of its own, told apart from the others by its sign
    out = written(out.select("vec_id", F.coalesce(F.col("inner") + F.coalesce("more", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", -1 - F.col("row")).alias("class")), "linked")
    least = out.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    out = spread_join(out, least, "class")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
