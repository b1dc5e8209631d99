"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Dates are compared with engines that have no session time zone, so the zone is pinned. AQE does
# the run-time work the operators rely on: it splits hot join partitions, turns a join into a
# broadcast join once the measured side is small, and evens out rebalanced writes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SHUFFLE_BYTES_PER_TASK = 128 << 20


def shuffle_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle partition count for a given input: about 128 MiB per task, never below the cores.

    AQE merges partitions that turn out small, so the estimate may safely be high.
    """
    wanted = max(cores, -(-input_bytes // SHUFFLE_BYTES_PER_TASK))
    return {"spark.sql.shuffle.partitions": str(wanted)}


def build_session(app_name: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with `SESSION_CONF`; `conf` (with `__` for `.`) overrides it."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    overrides = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**SESSION_CONF, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
