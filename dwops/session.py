"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Settings that can still be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where a later step would reuse its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Merge a key's sessions in each task first, so that a busy key is shuffled as sessions.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(master: str | None = None, app: str = "dwops", **settings: str) -> SparkSession:
    """Create (or get) a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors could not see it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="dwops-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder for one written table.

    All paths of an application lie in one folder, to be removed when it has ended.
    """
    return f"{shared_root(spark).rstrip('/')}/dwops-{spark.sparkContext.applicationId}/{uuid4().hex}/{name}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder once, for several later reads.

    A Parquet table cuts the lineage as a checkpoint does, and is read back by column and
    with known sizes, which join planning needs.
    """
    return stored_counted(df)[0]


def stored_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Like ``stored``, with the number of rows, counted while writing."""
    path, seen = fresh_path(df.sparkSession, "stored"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
