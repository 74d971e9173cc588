"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}

_own_dirs: dict[str, str] = {}


def build_session(
    app: str = "logmill", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g"
) -> SparkSession:
    """A local session for tests and the bench; on a cluster use spark-submit's."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it.

    Only a local session that names none gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="logmill-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of ours under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/logmill-{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage is cut,
    lost executors cost nothing, and the size is known to the planner."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def round_tables(spark: SparkSession, name: str):
    """For loops: returns a function that materializes one round and drops the
    files of the round before the last, which nothing reads any more."""
    base = scratch_path(spark, name)
    rounds = [0]

    def write(df: DataFrame) -> DataFrame:
        no = rounds[0]
        rounds[0] += 1
        df.write.parquet(f"{base}/{no}")
        if no >= 2:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{no - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return spark.read.schema(df.schema).parquet(f"{base}/{no}")

    return write


def clear_scratch(spark: SparkSession) -> None:
    """Drop everything this application wrote to the shared folder. Call it when
    no DataFrame made by the operators is needed any more."""
    path = f"{shared_dir(spark)}/logmill-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str, most: int = 64) -> DataFrame:
    """Spread a scan of very few splits over the cores, by key.

    Only small inputs have fewer splits than cores and than ``most``; others
    pass through unchanged.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, most)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
