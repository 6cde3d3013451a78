"""Session settings the plans in this package are written for, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

# Skewed joins are left to adaptive execution, which splits an oversized shuffle
# partition by what the map tasks really wrote.  Several plans join on the same key
# twice in one stage; without the "force" setting Spark gives up on splitting there
# because the second join then needs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Months and days are those of UTC, whatever the cluster's clock.
    "spark.sql.session.timeZone": "UTC",
}

# Read when a session starts, so :func:`configure` can only check them.  Above 2,000 shuffle
# partitions map tasks report average block sizes, and a skewed partition looks like any other,
# unless blocks far above the median are reported exactly.
START_CONF = {"spark.shuffle.accurateBlockSkewedFactor": "5.0"}
MANY_PARTITIONS = 2_000

# Input for one partition of a shuffle, and partitions at most: map tasks times partitions is
# what a shuffle has to index.
TARGET_PARTITION_BYTES = 1 << 30
MOST_PARTITIONS = 20_000

_local_scratch: str | None = None


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply :data:`RUNTIME_CONF`; with ``input_bytes`` also size the first shuffle.

    The initial partition count is an upper bound that adaptive execution coalesces
    downwards: one for every :data:`TARGET_PARTITION_BYTES` that reach the shuffle, never fewer
    than the session's own number and never more than :data:`MOST_PARTITIONS`.  Warns when it is
    so large that skew cannot be seen without :data:`START_CONF`.
    """
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    if input_bytes is not None:
        own = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = max(own, min(MOST_PARTITIONS, -(-input_bytes // TARGET_PARTITION_BYTES)))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
        if wanted > MANY_PARTITIONS:
            for name in START_CONF:
                if float(spark.conf.get(name, "-1")) <= 0:
                    warnings.warn(
                        f"start the session with {name}: with {wanted} partitions skewed ones "
                        "are not found without it",
                        stacklevel=2,
                    )
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder every executor can reach.

    That folder is what the session names in ``spark.checkpoint.dir``.  A local session
    without one gets a temporary folder; on a cluster its absence is an error, because a
    machine-local folder would lose files with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        global _local_scratch
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="loanloom-")
        base = _local_scratch
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
