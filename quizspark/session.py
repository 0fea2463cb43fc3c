"""Session helpers.

``get_session`` is for tests, the bench and the CLI; library functions take
whatever session the caller owns and never reconfigure it, except for the
checkpoint directory, which is only set when the cluster left it unset and
the master is local (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quizspark") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("QUIZSPARK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIZSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster configured.

    Reads ``spark.checkpoint.dir`` (and the SparkContext's current setting).
    Only when neither is set *and* the master is local (tests, laptops) a
    scratch folder is created; on a cluster an unset directory is an error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="quizspark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The parts of a union stay tasks of their own, also if each is a single one.
UNION_TASKS = {"spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the queries run meanwhile."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.
    Cuts the lineage as ``checkpoint`` does, and the size estimates too: those of
    a checkpointed table are its plan's, which grow without end over rounds of
    joins. What was shuffled for it is freed. ``by`` makes a folder for each value
    of a column, so that those of one value are read alone."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"
    with settings(spark, FREE_SHUFFLES | UNION_TASKS):
        (df.write.partitionBy(by).option("compression", "zstd") if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def ship_package(spark: SparkSession) -> None:
    """Make ``quizspark`` importable on executors (pandas UDFs reference its
    modules): zip the package on the driver and ``addPyFile`` it once per
    SparkContext — what ``spark-submit --py-files`` does."""
    sc = spark.sparkContext
    if getattr(sc, "_quizspark_shipped", False):
        return
    import zipfile

    if not os.path.isfile(__file__):  # imported from an archive, which the job already ships
        sc._quizspark_shipped = True
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="quizspark-pyfiles-"), "quizspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._quizspark_shipped = True
