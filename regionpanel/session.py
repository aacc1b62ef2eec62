"""Session settings and the reliable checkpoint folder.

``configure(spark)`` sets the SQL options the plans rely on; cluster-level
settings (executors, memory, checkpoint folder) belong to whoever starts the
cluster and are only read here.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "regionpanel",
                  event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, no server)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("REGIONPANEL_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    if event_log_dir:
        b = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
             .config("spark.eventLog.compress", "false"))
    for k, v in SQL_DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set by the cluster (a shared file system); only a
    local-mode session without one gets a fresh temporary folder. Works on a
    classic session and, through session settings only, on a remote one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: no SparkContext on this side
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and sc is not None:
        conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if sc is not None:
            sc.setCheckpointDir(conf)
            return sc.getCheckpointDir()
        return conf
    master = sc.master if sc is not None else (spark.conf.get("spark.master", "") or "")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
    if sc is not None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="regionpanel-ckpt-"))
        return sc.getCheckpointDir()
    if id(spark) not in _LOCAL_DIRS:
        _LOCAL_DIRS[id(spark)] = tempfile.mkdtemp(prefix="regionpanel-ckpt-")
    return _LOCAL_DIRS[id(spark)]


def release(df) -> None:
    """Delete a table written by ``materialise`` once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, label: str = "table"):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage (an executor lost later does not recompute the plan)
    and lets later passes read a columnar, pruned copy. One job, unlike an
    uncached ``checkpoint()`` which computes the plan twice.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
