"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import string
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.jobs.folders import shared_folder

#: What the contracts call white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which a table that was written and counted is broadcast.
SMALL = 1_000_000


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is (``lower`` would fold É or İ too)."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def crc_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``: which fold a row is in. Null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def hash128(*cols: Column | str) -> Column:
    """Two 64-bit hashes of different seeds as a struct: too wide to collide by chance on any corpus."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x51ED27), *cols).alias("b"))


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct, ``row``, beside columns of an operator's own: no name of a user's can clash with those."""
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever is in it, dots and backticks too."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(docs: DataFrame, *but: str) -> list[Column]:
    """The columns that :func:`boxed` has packed, but for those whose names Spark takes for one of ``but`` (case does not count)."""
    gone = {c.lower() for c in but}
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in gone]


def stored(df: DataFrame) -> str:
    """The path of the rows, written as Parquet to the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path that :func:`scratch` gave."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about ``size`` for jobs that run inside: buffers outside the heap stay small where rows are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
