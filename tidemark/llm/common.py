"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch of documents is cut to before Python code works on it.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of what lies before.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_joins(many: DataFrame, sides: list[tuple[DataFrame, str]], how: str = "inner") -> DataFrame:
    """many joined with the one row of its key on each side; the rows of keys that are very frequent are spread over several tasks.

    Such a key holds over a thousandth of all rows, so there are fewer than 1,000 of them, and they are broadcast.  Keys are counted
    before anything is joined, so what the sides bring along travels once a join.
    """
    most, rows, spread = max(many.count() // 1000, 1000), many, []
    for i, (one, key) in enumerate(sides):
        salt = f"_salt{i}"
        counts = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        hot = F.broadcast(written(counts.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")), "hot"))
        rows = rows.join(hot, key, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        spread.append((one.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"), key, salt))
    for one, key, salt in spread:
        rows = rows.join(one, [key, salt], how).drop(salt)
    return rows


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """spread_joins with one side."""
    return spread_joins(many, [(one, key)], how)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


#: Elements whose running results are put together by appending, which copies them; so work grows as their number.
RUN = 64


def runs(values: Column) -> Column:
    """The array cut into arrays of RUN elements."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(RUN)))


def sums_before(values: Column) -> Column:
    """array<int>: the sum of the elements before each of an array<int>."""
    none = F.array().cast("array<int>")

    def appended(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), none.alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return let(appended(totals, F.lit(0)), lambda at: F.flatten(F.transform(parts, lambda p, i: appended(p, F.get(at, i)))))

    return F.when(F.size(values) <= RUN, appended(values, F.lit(0))).otherwise(let(runs(values), joined))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text at most; one long text stands alone."""
    for batch in batches:
        at, size = 0, 0
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() for v in batch.column(text))]
        for i, n in enumerate(sizes):
            if i > at and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(sizes):
            yield batch.slice(at)
