"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# What the plans rely on. All are Spark defaults in 4.x except the time zone; they
# are spelled out because a site may have switched them off.
RELIED_ON = {
    "spark.sql.ansi.enabled": "true",  # required casts must raise, not yield NULL
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str, cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        **RELIED_ON,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.driver.memory": "8g",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting, such as a bare test, gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="jobmargin-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    return f"{shared_root(spark)}/jobmargin/{label}-{uuid.uuid4().hex}"
