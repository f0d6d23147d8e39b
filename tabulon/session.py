"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tabulon") -> SparkSession:
    """Build (or reuse) a session with AQE on.

    On a cluster the session is normally created by the launcher; this helper
    is for local runs, tests and the bench.
    """
    master = master or os.environ.get("TABULON_MASTER", "local[*]")
    parts = shuffle_partitions or int(os.environ.get("TABULON_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names the folder; we only read it.  Only when it is unset and
    the master is local (tests, bench) do we fall back to a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it to a shared folder "
            "(HDFS / object store) before running iterative operators")
    path = tempfile.mkdtemp(prefix="tabulon-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the DataFrame as a Parquet table under the
    shared checkpoint folder and reading it back.

    Unlike ``RDD.checkpoint`` (which recomputes the plan a second time to
    write its files) the plan runs once; the table survives the loss of
    executors (unlike a local checkpoint) and is read back column-pruned."""
    spark = df.sparkSession
    path = scratch_dir(spark, "stage")
    df.write.mode("overwrite").parquet(path)
    release_shuffles(spark, path)
    out = spark.read.parquet(path)
    out._stage = path
    return out


def let_go(stage: DataFrame) -> None:
    """Delete a stage table of :func:`cut_lineage` that no plan reads any more."""
    spark = stage.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stage._stage)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of tables written between two calls for the shuffles that made them.
RELEASE_BYTES = 32 * 2**20
_WRITTEN: dict[str, int] = {}


def release_shuffles(spark: SparkSession, path: str) -> None:
    """Let go of the shuffle files of finished plans once tables of
    ``RELEASE_BYTES`` (with the one at ``path``) are written.  Spark deletes a
    shuffle when the driver has collected its plan, which a driver with room to
    spare puts off, so that the files of all stages would lie side by side."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    app = spark.sparkContext.applicationId
    _WRITTEN[app] = _WRITTEN.get(app, 0) + size
    if _WRITTEN[app] >= RELEASE_BYTES:
        _WRITTEN[app] = 0
        spark._jvm.System.gc()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, under the shared checkpoint
    folder (never a machine-local path on a cluster)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabulon-scratch/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabulon`` importable on the executors' Python workers (the
    pandas-UDF kernels are pickled by module reference): zip the package
    once per application and distribute it with ``addPyFile``."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="tabulon-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
