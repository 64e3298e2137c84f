"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session gets: AQE re-plans joins/aggregates at run time,
# splits skewed join partitions and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Inputs in a few files are still read in as many splits as row groups allow.
    "spark.sql.files.maxPartitionBytes": "16m",
}


_WRITTEN: list[str] = []  # tables written by cut_lineage and not dropped yet


def get_spark(master: str | None = None, app: str = "assaylake",
              shuffle_partitions: int | None = None,
              conf: dict[str, str] | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    settings.setdefault("spark.driver.memory", "16g")
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is. Only a
    local-mode session without the setting (tests, the bench) gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="assaylake-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder.

    Computed once (an eager ``DataFrame.checkpoint()`` runs its input twice:
    once to count, once to write), stored on the reliable storage the
    cluster names, and read back with a plan that starts at the files, so a
    lost executor re-reads instead of recomputing the lineage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def track_written(path: str) -> None:
    """Have :func:`drop_intermediates` delete ``path`` as well."""
    _WRITTEN.append(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut_lineage` wrote so far; returns how many.

    For the caller that knows its results have been written: frames that
    still read these tables fail afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def recommended_conf(input_bytes: int, total_cores: int,
                     target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Spill-aware settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions hold about ``target_partition_bytes`` each (and at
    least three per core so stragglers even out); AQE coalesces small ones
    and splits skewed ones at four times the advisory size.
    """
    import math
    parts = max(3 * total_cores, math.ceil(input_bytes / target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Make ``assaylake`` importable in the Python workers (once per application).

    Pandas kernels and hooks are pickled by reference to this package; the
    package is zipped on the driver and added with ``addPyFile``, which
    serves it to every executor (the same as ``--py-files``).
    """
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = tempfile.mkdtemp(prefix="assaylake-pkg-")
    zpath = os.path.join(out, "assaylake.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
