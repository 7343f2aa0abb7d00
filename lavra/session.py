"""Session and shared-storage helpers used by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Upper bounds, in rows and in bytes of their JSON form, below which a helper may broadcast a frame.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def get_session(app: str = "lavra", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only in a local session that names none."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lavra-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpoint ``df`` and hint a broadcast only when its rows and their bytes, both measured, stay under the bounds.

    Beyond them the frame is returned without a hint, and the join falls
    back to Spark's shuffled join, which AQE splits where a key is hot.
    """
    kept = cut(df)
    n, length = kept.limit(rows + 1).selectExpr("count(*)", "coalesce(sum(octet_length(to_json(struct(*)))), 0)").first()
    return F.broadcast(kept) if n <= rows and length <= size else kept


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows spread by ``columns`` over all cores, for frames of few bytes and much work a row.

    The explicit number keeps AQE from gathering them into one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)
