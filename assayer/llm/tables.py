"""Reading input tables, and written tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in a local session (as in tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="assayer-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, with their lineage cut: a lost executor loses none of them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage is cut, and Spark knows the table's size when it plans a join."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gone(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a step of this library wrote."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


class Scratch:
    """Written tables that go when the block that made them ends; what it returns must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes the tables of a name before the block ends."""
        for path in self.paths.pop(name, ()):
            gone(self.spark, path)

    def __exit__(self, *_) -> None:
        for name in list(self.paths):
            self.drop(name)


#: Most rows that `checked` lets Spark broadcast.
BROADCAST_ROWS = 400_000


def checked(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has `BROADCAST_ROWS` rows at most, and else to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def held_out(doc_id: str, folds: int, fold: int):
    """True for rows of the fold: crc32 of the id as text, modulo the number of folds."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, the same each time: those whose key's hash is small (all, if there are no more)."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 40)) < F.lit(int((1 << 40) * rows / n)))


def fresh() -> str:
    """A name that no folder has yet."""
    return uuid.uuid4().hex
