"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and coalesces partitions at
# runtime, skew join splits hot band buckets / hot query columns, and Arrow
# carries the few pandas UDFs.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "unionlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``unionlake`` importable by the Python workers (the UDFs refer to
    its helpers): zip the package once per application and ``addPyFile`` it,
    as ``--py-files`` would.  Skipped when the submit already ships it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if "unionlake" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(sc.applicationId)
        return
    import zipfile
    import unionlake
    pkg = os.path.dirname(os.path.abspath(unionlake.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="unionlake-pkg-"), "unionlake.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> str:
    """Everything a job needs from its session: the package on the workers
    and the shared checkpoint folder (returned).  Shuffle files go when their
    query is over: what a later query needs is written as a table.  Arrow
    batches are bounded in bytes, as a batch is held on both sides of a worker's
    pipe at a time."""
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediates.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system).  Only when nothing is configured -- local runs and tests --
    a private temporary folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="unionlake-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tables", name)


def materialize(df, name: str = "t"):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint folder and reading it back.  Unlike ``checkpoint()`` (which
    runs the plan once to count and again to save unless it is cached), the
    plan runs exactly once; a lost executor costs a re-read, not a re-plan."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
