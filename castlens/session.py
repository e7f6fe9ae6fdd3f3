"""Session helpers: builder defaults, shared checkpoint folder, scratch paths.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever launches the job, e.g. an HDFS/S3 path). Only a local-mode session
(tests, bench) without that setting gets a fresh folder under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for sessions this library creates itself (tests, bench). A session
# handed in by the caller is never reconfigured except for the checkpoint dir.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "castlens", extra: dict | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("CASTLENS_DRIVER_MEMORY", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def _is_local(spark: SparkSession) -> bool:
    sc = _context(spark)
    master = sc.master if sc is not None else (spark.conf.get("spark.master", "") or "")
    return master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset and
    the session is local is a private folder created; a cluster session without
    the setting is an error, because a machine-local folder would not survive
    the loss of the executor that wrote it.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/…) for cluster runs")
        conf_dir = tempfile.mkdtemp(prefix="castlens-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    spark.conf.set("spark.checkpoint.dir", conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder; see :func:`clear_scratch`."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch copy under this session's checkpoint folder.

    DataFrames that still read one must be written first; call it between jobs or at the end of one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of input.

    * Shuffle partitions: enough that each holds about ``target_partition_bytes``
      of shuffled data (assuming a shuffle as large as the input), and at least
      three waves of tasks. Every reducer fetches a segment from every mapper;
      raise ``target_partition_bytes`` to trade fetches for larger partitions.
      AQE coalesces them at run time when a shuffle turns out smaller.
    * Input splits of ``target_partition_bytes``; AQE's advisory size and the
      skew thresholds at the same size, so a partition several times the median
      and above that size is split.
    For 100 TB on 8,000 cores with 1 GB as target: 100k shuffle partitions.
    """
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    size = str(target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.checkpoint.compress": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
