"""Shared helpers: table access, shared-folder materialisation, Arrow kernels and digests."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where none is configured and one machine does all the work (tests); a cluster without one is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="evspark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def reader(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that have ended, which waits for the driver's next collection."""
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it: lineage ends there, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    release_shuffles(df.sparkSession)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return reader(df, path)


def without_rows(docs: DataFrame, id_col: str, key: Column, going: DataFrame, **sizes: int) -> DataFrame:
    """``docs`` without the rows that have an id and key of ``going`` (columns _id, _key, kept), null ids included.

    Where ``kept`` is true, several rows share id and key, and the first of them by all columns (as JSON, so that columns of
    any type will do) stays. Rows that a filter of ``going`` tells apart pass straight through, at any size; the others are
    joined. Columns of any name stay as they are.
    """
    from .exact_dedup import split_by_members

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.explode_outer(F.array(key)).alias("key"))  # made once a row
    probe = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "key")
    going = going.select("_id", "_key", "kept", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_key").alias("_probe"))
    rest, passing = split_by_members(keyed, probe, going, "_probe", going.count(), **sizes)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    left = rest.join(going, same, "left_anti").unionByName(passing).select("row.*")
    tied = going.filter("kept").select("_id", "_key")
    if tied.isEmpty():
        return left
    one = rest.join(tied, same, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.unionByName(one.select("row.*"))


#: Rows in an Arrow batch between the JVM and Python: texts are long, and both sides hold a few batches.
ARROW_ROWS = 500


def bound_batches(df: DataFrame) -> DataFrame:
    """Keeps the session's Arrow batches small; to be called by every operator that sends texts to Python."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ASCII strings take the fast built-in; the rest go through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def release_memory() -> None:
    """Hands freed memory back to the system. Workers live on between tasks, and next to each other in one executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Emitter:
    """Collects output rows column-wise and yields Arrow batches of bounded rows and payload."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 16 << 20):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self.columns: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, *row, weight: int = 0) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += weight

    @property
    def full(self) -> bool:
        return len(self.columns[0]) >= self.max_rows or self.size >= self.max_bytes

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        self.size = 0
        return batch

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()
        release_memory()


def text_rows(batch: pa.RecordBatch, id_at: int = 0, text_at: int = 1) -> Iterator[tuple[object, str | None]]:
    """(id, text) pairs of a batch, one text in memory as Python string at a time."""
    ids, texts = batch.column(id_at), batch.column(text_at)
    for i in range(batch.num_rows):
        yield ids[i].as_py(), texts[i].as_py()


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus
