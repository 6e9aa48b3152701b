"""What the training-data operators share: shared scratch tables and small helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session has none (a local test run) one is made on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        made = tempfile.TemporaryDirectory(prefix="chronoframe-")
        atexit.register(made.cleanup)
        _LOCAL[key] = f"file://{made.name}"
    return _LOCAL[key]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: lineage ends here."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a kept table that nothing will read any more."""
        for name in df.inputFiles()[:1]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
            fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(folder, True)


_HELD: dict = {}


def held(key, make):
    """What make() gives: a worker makes it once for a key, and holds only the last key's."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket(column: str, modulus: int):
    """crc32 of a column as text, modulo a number; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others cannot clash with computed ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., whose names no computed column has, and the new name by the old one."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def renamed(names: dict[str, str], **instead: Column) -> list[Column]:
    """Columns that undo numbered(); instead has new values by old name."""
    return [instead.get(old, F.col(new)).alias(old) for old, new in names.items()]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
