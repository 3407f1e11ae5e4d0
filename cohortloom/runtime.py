"""Session settings, the shared working folder and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 100_000


def local_session(cores: int | str = 8, app: str = "cohortloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # a pass of a fit is a job of milliseconds; over TCP each waits for delayed acknowledgements
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since a machine-local folder loses data with
    its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_local(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame | None:
    """``df`` as driver rows if it has at most ``limit`` rows, else None."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a model-sized table, refusing anything above ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Join a summary table: broadcast when it is counted to be small.

    Above ``limit`` rows the plain join is used, so Spark may shuffle both
    sides and split skewed keys at run time.
    """
    local = small_local(small, limit)
    if local is None:
        return big.join(small, on, how)
    return big.join(F.broadcast(local), on, how)
