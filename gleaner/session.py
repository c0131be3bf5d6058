"""Session settings the jobs rely on, and tables kept in the shared folder between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all of them may be set on a session that already runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot site or url in an equi join is split at run time, also when a
    # grouping on the same key follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Whole pages travel to the Python workers, so batches hold few rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    # A rule may name a member twice; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Stream state (every url ever seen, every site's clock) outgrows executor memory.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# How files with pages and bodies are written: they take a third less than under Spark's default.
BODY_FILES = {"compression": "zstd"}


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session and ship this package to its workers once."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if not getattr(context, "_gleaner_shipped", False):
        context.addPyFile(_package_zip())
        context._gleaner_shipped = True
    return spark


def _package_zip() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gleaner-"), "gleaner.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    return target


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not hasattr(context, "_gleaner_dir"):
        context._gleaner_dir = tempfile.mkdtemp(prefix="gleaner-shared-")
    return context._gleaner_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write rows once as a table in the shared folder and go on from there.

    Used where several readers must see the very same rows (numbering) or
    where reading again costs less than working out again (parsed pages). What
    follows survives the loss of executors and reads only the columns it needs.
    """
    path = new_folder(df.sparkSession, "tables")
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)
