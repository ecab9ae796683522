"""Where intermediate tables go, and how lineage is cut.

Every table that outlives one job is written as Parquet below the folder named
by ``spark.checkpoint.dir``, which all executors share, and read back from
there: a lost executor then costs a re-read, never a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only for a local master that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="stagewise-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:16]}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: Spark's default one if it names none, as executors read it the same way."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_rows(docs: DataFrame, name: str) -> DataFrame:
    """``whole`` (a struct of all columns) and ``row``, a text that no other row has and that every later read repeats.

    A plain scan of files names a row by its file (128 bits of hash) and its
    place there; anything else is written once and then is such a scan.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in docs.columns:
        docs = staged(docs, name)
    path = F.col("_metadata.file_path")
    row = F.concat_ws("-", F.hex(F.xxhash64(path)), F.hex(F.xxhash64(path, F.lit(1))), F.col("_metadata.row_index"))
    return docs.select(F.struct(*docs.columns).alias("whole"), row.alias("row"))


def discard(*tables: DataFrame) -> None:
    """Removes the folders of ``staged`` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
