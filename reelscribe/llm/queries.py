"""One query for each operator of this subpackage, over its whole table, and its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscribe.llm import chunk_dedup, decontaminate, hard_negatives, language, licenses, line_dedup, line_rules, packing, quality_model, sharding, simhash, toxicity, twins, whitening

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_line_dedup", twins.LINE_DEDUP)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("n_lines_before").cast("long").alias("n_lines"),
        (F.col("n_lines_before") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op8_quality_rules", twins.QUALITY_RULES)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")
    return judged.select("doc_id", *(f"judged.{f}" for f in fields))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_benchmark_decontamination", twins.DECONTAMINATION)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op1_license_scans", twins.LICENCES)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents"))
    exact = F.filter("spans", lambda x: x["exact"])
    starts = F.transform(exact, lambda x: x["start"])

    def joined(spans):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf, "documents")).drop("text_hash")


@query("op4_toxicity")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_hard_negative_mining", twins.HARD_NEGATIVES)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


@query("op12_sharding", twins.SHARDS)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))
