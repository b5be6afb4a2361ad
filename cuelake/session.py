"""Session settings and small cluster-safe helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for plan shape. They are runtime SQL settings, so a cluster
# session can take them over without a restart.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins by track and place deal rows by both, as one track may be large; ``dealt_by_track`` is the exception.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.session.timeZone": "UTC",
    # Where many paths are listed, as each batch of a stream of files does, a task takes many of them.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # A table's listing is in its index; the cache would keep the driver's copies of the paths of all batches as well.
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    # ``listed_without_places`` is the exception.
    "spark.sql.sources.ignoreDataLocality": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches hold whole cue texts: bound them by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(master: str = "local[8]", app: str = "cuelake", **conf: str) -> SparkSession:
    """A local session with the plan settings; clusters bring their own."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**base, **PLAN_SETTINGS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session made elsewhere."""
    for k, v in PLAN_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def dealt_by_track(spark: SparkSession) -> SparkSession:
    """Until the next ``tune``: a join by track and place leaves rows where they are if they are dealt by the track.

    For texts cut out of one row per title: those of a title are in one task already, so dealing them by place as well
    only moves every text again.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def listed_without_places(spark: SparkSession) -> SparkSession:
    """Until the next ``tune``: a listing leaves out where the blocks of each file are.

    For very many small files, of which a task reads hundreds: it is near none of them, and the driver holds the listing.
    """
    spark.conf.set("spark.sql.sources.ignoreDataLocality", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as named by the cluster; a new local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="cuelake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def made_once(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write the rows to the shared folder, or to ``at``, and read them back, so that several readers see the same rows."""
    path = at or f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unmade(spark: SparkSession, path: str) -> None:
    """Delete a folder of rows made once, whatever file system it is on, when nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    spark = df.sparkSession
    jsc = spark.sparkContext
    if jsc._jsc.sc().getCheckpointDir().isEmpty():
        jsc.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def spread_few(df: DataFrame, key: str) -> DataFrame:
    """``spread`` if the table has too few splits to keep the cores busy; else the rows stay where they are read."""
    return df if df.rdd.getNumPartitions() >= 2 * df.sparkSession.sparkContext.defaultParallelism else spread(df, key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows by a key once, whatever the number of splits.

    A few large files would leave most cores idle in front of row-local text work, and several
    branches over the same texts share this exchange instead of reading the table again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)
