"""Session settings the results depend on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Results depend on these: UTC dates, and JSON objects whose last duplicate key wins.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# A row wider than this is handled operator by operator, in many small methods. One method for
# all columns of an event is interpreted by the JVM for long, or for good beyond 8,000 bytes.
GENERATED = {"spark.sql.codegen.maxFields": "50", "spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to an existing session."""
    for key, value in {**REQUIRED_CONF, **GENERATED}.items():
        spark.conf.set(key, value)
    # A fixed lower bound keeps file splits equal between two scans of the same
    # files, also when executors come and go in between (see sources.batches).
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )
    return spark


def build(app: str = "tallyline", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; cluster settings (memory, executors) come from spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the folder all executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")
