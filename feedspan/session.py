"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Runtime-changeable settings the jobs are designed for. The skew-join setting
# lets AQE split a hot key even where the split costs one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    # Each partition's store of each run would set 4 MB and more of disk aside, however few keys it has.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Deep pages per key still get cut in every task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}

def build_session(app: str = "feedspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for stream state and staged tables.

    The cluster names the parent in `spark.checkpoint.dir`. Only a local master
    may fall back to a temporary folder of this machine.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        parent = tempfile.mkdtemp(prefix="feedspan-")
    return f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
