"""What the corpus operators share: the folder all executors see, lineage cuts, and Arrow batch sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts may be long, so batches are kept short; this bounds memory, not results.
ARROW_ROWS, ARROW_BYTES = 200, 32 << 20
#: Groups that join_groups() may broadcast, and rows that a group needs at least for that.
HOT_GROUPS, HOT_ROWS = 1 << 14, 2048

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spiketide-"))


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() usable and bound the rows and bytes of an Arrow batch; narrower bounds of the session stay."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder; later steps survive the loss of any executor."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """cut() for rounds that join what earlier rounds have cut; needs a classic session.

    Spark guesses a join's size as the product of its sides, and a checkpoint keeps the guess: it has four times the digits
    after each round of two joins, until the number itself fills the driver's heap. Here the rows are kept without it.
    """
    spark, kept = df.sparkSession, cut(df)._jdf
    rows = kept.queryExecution().analyzed().rdd()  # a checkpoint's plan is the table of its rows
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept.schema(), False), spark)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """rows joined with groups, which has one row to a key and in `size` the number of rows of that key.

    Groups of more than 1/HOT_GROUPS of the rows are fewer than HOT_GROUPS, so they are broadcast and their rows stay
    where they are; the others are small beside the whole and meet by a shuffle. Both tables are read twice: cut them.
    """
    every, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_ROWS, (every or 0) // HOT_GROUPS)
    if (most or 0) <= least:
        return rows.join(groups, keys)
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
