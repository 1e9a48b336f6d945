"""Exact deduplication as a stream: keyed state on disk that never expires, full bytes checked on hits.

Two streams follow each other. The first reads new files of documents and writes a ledger: id, digest and place of
every row. The second folds the ledger into state in RocksDB, a key for each digest: how many rows have it, which of
them stays, and where that row's content lies. Rows whose digest is hit again are fetched by their places and compared
byte by byte. Calling again with the same folder takes up files that came since; a lost executor costs its tasks only,
for ledger, state and offsets lie in the shared folder.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, join_groups, shared_dir

#: Bytes of SHA-256 that key the state. Texts that share them are told apart by their bytes.
KEY_BYTES = 16
#: Bytes of files to a micro-batch of the first stream.
BATCH_BYTES = 64 << 30
#: Rows of the first ledger to a partition of the state, and the most partitions. Each is a RocksDB of its own,
#: and their number stays as it is once there is state.
STATE_ROWS, STATE_PARTS = 1 << 16, 1 << 13
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ["file", "row"]


def normalised(text: Column) -> Column:
    """A-Z in lower case; null: empty. In texts of ASCII only, lower() does just that."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _watched(spark: SparkSession, path: str) -> str:
    """A stream follows folders and patterns; one file is given as a pattern that only it matches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return path if folder else f"{path[:-1]}[{path[-1]}]"


def follow(spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES, batch: dict | None = None) -> None:
    """Take all files under path that the folder has not seen into its ledger and state. batch: options that bound a
    micro-batch of the first stream."""
    own = spark.newSession()  # settings of the streams only
    for name, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store sets megabytes of disk aside
    }.items():
        own.conf.set(name, value)
    docs = own.readStream.schema(spark.read.parquet(path).schema).options(**(batch or {"maxBytesPerTrigger": BATCH_BYTES})).parquet(_watched(spark, path))
    sha = F.unhex(F.sha2("text", 256))
    ledger = _placed(docs, id_col, text_col).select("id", sha.alias("sha"), F.substring(sha, 1, key_bytes).alias("key"), *PLACE)
    stream = lambda df, name: df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-progress")
    stream(ledger, "ledger").format("parquet").start(f"{folder}/ledger").awaitTermination()
    rows = spark.read.parquet(f"{folder}/ledger").count()
    own.conf.set("spark.sql.shuffle.partitions", str(min(STATE_PARTS, rows // STATE_ROWS + 1)))
    seen = own.readStream.schema(ledger.schema).parquet(f"{folder}/ledger")
    state = seen.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("id", *PLACE)).alias("best"))
    stream(state, "state").outputMode("update").format("noop").start().awaitTermination()


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """(key, n, best) as the state store holds it after the last batch."""
    held = spark.read.format("statestore").load(f"{folder}/state-progress")
    return held.select(F.col("key.key").alias("key"), F.col("value.count").alias("n"), F.col("value.max").alias("best"))


def _told_apart(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """(file, row, n, best) of rows whose key several texts share: their groups are those of equal bytes."""
    members = texts.join(mixed.select("key"), "key", "left_semi")
    groups = members.groupBy("key", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", *PLACE)).alias("best"))
    return members.join(groups, ["key", "text"]).select(*PLACE, "n", "best")


def deduplicate(spark: SparkSession, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES, batch: dict | None = None) -> DataFrame:
    """(id, keep_id, n, kept, sha): for every row of the Parquet files under path the id of the row that stays of all
    with its text, the number of these rows, whether it is that row, and the text's SHA-256.

    Texts are equal if they are after lower-casing A-Z; null is empty. The row of the largest id stays, null ids
    last; of rows equal in id and text, the one of the last file and place. An empty table gives no rows. folder: where ledger and state are kept between
    calls, a new one if not given; files under path are never changed once read.

    Copies are counted before they are shuffled; rows meet their group by join_groups(), which leaves those of large
    groups where they are. Of a group's copies, each task sends one text at most to be compared.
    """
    folder = folder or new_folder(spark)
    follow(spark, path, folder, id_col, text_col, key_bytes, batch)
    ledger, state = spark.read.parquet(f"{folder}/ledger"), _state(spark, folder)
    rows = cut(join_groups(ledger, cut(state), ["key"]))
    hits = rows.filter("n > 1").select("key", *PLACE)
    texts = _placed(spark.read.parquet(path), id_col, text_col).join(hits, PLACE)
    mixed = cut(texts.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("key"))
    if not mixed.isEmpty():
        apart = _told_apart(texts, mixed)
        rows = rows.join(mixed, "key", "left_anti").unionByName(rows.join(mixed, "key", "left_semi").drop("n", "best").join(apart, PLACE))
    here = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
    return rows.select("id", F.col("best.id").alias("keep_id"), "n", here.alias("kept"), F.lower(F.hex("sha")).alias("sha"))
