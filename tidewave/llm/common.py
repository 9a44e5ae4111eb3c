"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, as characters.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a class in a regular expression, and a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Five words and a similarity of three quarters, unless a contract says otherwise.
SHINGLE_WORDS = 5
SIMILARITY_NUM, SIMILARITY_DEN = 75, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in spark.checkpoint.dir.

    A folder of our own is set only where the session names none and everything runs
    in one process (local runs and tests); a cluster must name one.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewave-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it from there, which ends its lineage.

    Rows come back in other partitions and in any order. For rows of some MB, ``group_bytes`` bounds the
    row groups, which else have a hundred rows at least and are read 4,096 rows at once.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    if group_bytes:
        write = write.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_order(df: DataFrame) -> DataFrame:
    """Like cut, but partitions and the order of their rows stay as they are (Spark's checkpoint in the shared folder)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more; shuffle files nobody refers to go with them.

    Spark's cleaner only sees what the JVM has collected, so it is asked to collect.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
