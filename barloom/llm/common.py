"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE_CLASS = "\\x09-\\x0D "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Catalyst inlines aliases that are used inside higher-order functions, which would
    evaluate the aliased expression once per array element; a lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(column: str | Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def split_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words, as long."""
    return F.size(split_words(text)).cast("long")


#: A single machine's folder, for sessions in local mode that name none.
LOCAL_DIR = "/tmp/barloom-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session; in local mode one of our own if none is configured, on a cluster an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or LOCAL_DIR)
    return configured or LOCAL_DIR


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` begins with."""
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def rows_per_task(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
