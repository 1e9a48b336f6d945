"""The queries of the corpus operators: (spark, sf_dir) -> DataFrame, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, binary, decontaminate, exact, lexical, lines, mixing, neighbours, private, quality, secrets, simhash, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.scan(table(spark, sf_dir, "documents")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.delete_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", "repeat_depth", F.sha2("kept", 256).alias("kept_sha256"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = binary.new_folder(spark)
    manifest = binary.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return binary.read_digests(manifest, out)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.filter("vec_id % 50 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orders(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), F.col("place").alias("rank"), F.col("id").alias("doc_id"), "score")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


_EVERY = (
    op1_quality, op2_simhash, op3_decontaminate, op4_private, op5_lines, op6_tokens, op7_secrets, op8_repeats, op9_nearest, op10_mixing, op11_audit, op12_search, op13_exact,
)
QUERIES = {f.__name__: f for f in _EVERY}
