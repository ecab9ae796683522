"""SparkSession construction with the settings the funnel jobs rely on.

Cluster sessions keep whatever the deployment configured; these helpers only
fill in settings that are unset, so a cluster's shared checkpoint folder,
shuffle sizing and memory settings always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every funnel job needs for correct and scalable plans.
# - UTC session zone: the input timestamps are TIMESTAMP_NTZ and no plan
#   depends on the zone; results that a client prints stay comparable.
# - AQE: runtime coalescing of the many tiny post-aggregation partitions,
#   runtime broadcast of sides that turn out small (a measured size check),
#   and splitting of skewed join partitions (one user may own a third of rides).
# - ANSI mode stays on: overflow and bad casts fail loudly instead of wrapping.
# - No Python call-site capture: with it, every Column function costs extra
#   JVM round trips, which dominated plan construction of the larger funnels.
DEFAULT_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "stagewise",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them ``None`` so the submit-time configuration applies.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a local one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; a cluster that names none gets an error, as executors do not see
    each other's disks. Only local runs (tests, bench) get a scratch folder.
    """
    sc = spark.sparkContext
    current = (
        sc.getConf().get("spark.checkpoint.dir", None)
        or spark.conf.get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not is_local(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="stagewise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
