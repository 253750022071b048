"""Session setup shared by the library, tests and the bench.

Nothing here is required on a managed cluster: every operator works with
whatever session the caller passes in. ``configure`` only sets runtime SQL
options that change results (time zone) or plans (AQE), and
``checkpoint_dir`` honours ``spark.checkpoint.dir`` when the cluster sets it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime options every operator relies on. They are SQL confs, so they can be
# set on a live session without a restart.
RUNTIME_CONF = {
    # Month buckets and timestamp parsing must not depend on the host zone.
    "spark.sql.session.timeZone": "UTC",
    # Let AQE coalesce small shuffle partitions and split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bytes of one Arrow batch: long texts must not pile up in a Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime options above to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_spark(
    master: str | None = None,
    app_name: str = "tabscope",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session for local work, tests and the bench.

    On a cluster, create the session with the cluster's launcher instead and
    call :func:`configure` on it.
    """
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", os.environ.get("TABSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only locally.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value
    always wins. Only a ``local[...]`` master (tests, bench) without the setting
    gets a fresh scratch folder. On a cluster without the setting we refuse,
    because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so checkpoints survive executor loss"
        )
    scratch = tempfile.mkdtemp(prefix="tabscope-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


# Folders that this process wrote below the checkpoint folder and still holds.
_SCRATCH: list[str] = []


def materialize(df: DataFrame, label: str = "step", keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()``, but the files are columnar and
    compressed, so later readers prune columns. A lost executor costs nothing:
    the table lies in shared storage. The folder is a fresh one per call; it
    goes with the checkpoint folder, or earlier at the end of the
    :func:`scratch_scope` it was written in (unless ``keep``).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabscope-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not keep:
        _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, at the end, what :func:`materialize` wrote inside (except
    ``keep``). Only for results that no longer read it: written, or kept."""
    start = len(_SCRATCH)
    yield
    mine, _SCRATCH[start:] = _SCRATCH[start:], []
    for path in mine:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
