"""Session settings and the few places where a plan must be cut or written down."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Applied only where the caller builds the session here. Shuffle partitions are left
# to the cluster: AQE coalesces down from a generous start and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "firmaforge", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder that the session names in ``spark.checkpoint.dir``.

    Where none is set, a private folder that goes when the program ends, but only if driver
    and executors are one process; on a cluster other machines would not see it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="firmaforge-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A table rather than a checkpointed RDD: it survives lost executors just the same, and the
    steps that follow read only the columns they need and know its size.
    """
    path = new_shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _CUTS[id(out)] = (out, path)
    return out


# The tables of this program's cuts, so that they can be deleted.
_CUTS: dict[int, tuple[DataFrame, str]] = {}


def discard(*cuts: DataFrame) -> None:
    """Delete tables of :func:`cut` that no plan reads any more."""
    for df in cuts:
        _, path = _CUTS.pop(id(df), (None, None))
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def discard_all() -> None:
    """Delete all tables of :func:`cut`: call it when the results are written."""
    discard(*[df for df, _ in list(_CUTS.values())])


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
