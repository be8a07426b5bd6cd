"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every fianchetto job relies on.  Adaptive execution re-plans joins and
# coalesces shuffle partitions from runtime statistics; skew handling splits hot
# partitions.  UTC keeps timestamp arithmetic identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text parsing and move replay are CPU-bound: keep post-shuffle partitions
    # small enough that every core gets work even when the bytes are few
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of games are wide: Arrow batches are bounded in bytes, not only in rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Python workers talk over Unix sockets: over local TCP, tasks that moved many GB were seen to stand still for good
    "spark.python.unix.domain.socket.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    # checkpoints written by materialize=True are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "fianchetto",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with fianchetto's defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (it has to be shared storage that
    survives executor loss).  Only a local session without one gets a private
    folder, as in tests.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="fianchetto-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "fianchetto", f"{name}-{uuid.uuid4().hex[:12]}")


#: Rows and bytes of an Arrow batch of wide rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on, the session hands rows to Python workers in batches of bounded size (a worker holds one)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Rows of an Arrow batch of narrow rows.
NARROW_ROWS = 10_000


def narrow_batches(spark: SparkSession) -> None:
    """From here on, the session bounds the batches it hands to Python workers in rows alone, for rows of a few short
    values: with a bound in bytes, Spark sums up the sizes of all buffers after every single row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", NARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", (1 << 31) - 1)
