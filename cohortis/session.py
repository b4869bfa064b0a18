"""Session settings and lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Most rows a table may have and still be sent to every executor.
BROADCAST_ROWS = 200_000


def build_session(app: str = "cohortis", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the results rely on; AQE splits skewed joins and joins small sides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> bool:
    """Use the folder the session names; whether there is one."""
    sc = spark.sparkContext
    shared, now = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if shared and not (now and shared.removeprefix("file:").rstrip("/") in now):
        sc.setCheckpointDir(shared)
    return bool(shared or now)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from the result.

    It goes to the checkpoint folder that the session names, which all executors share: files outlive a lost executor,
    so iterative jobs never replay earlier rounds. Without such a folder the result is kept by the executors and
    computed again where it is lost.
    """
    if _checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    kept = df.persist()
    kept.count()
    return kept


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet to the folder the session names for checkpoints, and read from there.

    Takes less room than :func:`cut` and lets later steps read some columns. Where the session names no folder, it is cut.
    """
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return cut(df)
    folder = f"{shared.rstrip('/')}/stored-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession) -> str:
    """A folder of one's own under the one the session names for checkpoints, which all executors share.

    Where it names none, as on one machine, a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{mkdtemp(prefix='cohortis-')}"
    return f"{shared.rstrip('/')}/{uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within leave no shuffle files: Spark removes them as each ends.

    Else they stay until the driver's collector finds that nothing refers to them, which may be half an hour later; to
    ask for full collections instead makes the driver's heap grow, as the time they take counts against it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
