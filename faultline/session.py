"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", app: str = "faultline", **conf: str) -> SparkSession:
    """Session for tests and the single-machine benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        **REQUIRED_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


PINNED = {
    "spark.sql.session.timeZone": "UTC",
    # Joins over unions of equally partitioned inputs can be planned with unequal partition counts.
    "spark.sql.unionOutputPartitioning": "false",
    # State with timers needs this store; sessions shrink inside each task before the shuffle.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Set the runtime options results depend on."""
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The default suits a cluster; on one machine it means hundreds of empty tasks per shuffle.
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
    return spark


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for cut points: the one the cluster names, else a temporary one on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="faultline-")
    return _LOCAL_SCRATCH[sc.applicationId]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The plan behind the result is a plain scan, so an iteration neither grows its lineage nor
    recomputes, and losing an executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/faultline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
