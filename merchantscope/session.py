"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings every job assumes. Partition counts are left to the cluster: AQE
#: coalesces small shuffle partitions and splits skewed ones at run time. The JVM does
#: not compile methods beyond 8000 bytes; a stage whose loop is longer runs as separate
#: steps, which are compiled, instead of being interpreted row by row.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the jobs rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="merchantscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/merchantscope/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a result feeds several passes. Unlike a cached or checkpointed
    frame the table keeps column pruning, filter push-down and size statistics
    (which let Spark choose broadcast joins by measured size), and it survives the
    loss of executors. ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose rows are counted (``rows``) and aggregated as an action goes over them.

    The figures belong to the first action and cost no job. Write the frame as it is: with
    no exchange between here and the files a repeated task counts once.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), seen


def stage_counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage_table`` and figures of its rows, taken while they are written."""
    watched, seen = observed(df, **metrics)
    return stage_table(watched, name), seen.get
