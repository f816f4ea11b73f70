"""The registered queries of the operators; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.llm import brown, decontaminate, exactdup, htmlmain, langid, linededup, neardup, packing, quality, resample, substring, toxicity, vectorcodes
from lorefield.llm.common import documents, held_out
from lorefield.llm.oracles import ORACLES  # noqa: F401  (read by the registry)
from lorefield.session import checkpointed, table


def op1_packing(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, base), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    done = linededup.dedup_lines(documents(spark, base).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, base), shingle=4)


def op4_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base).select("doc_id", "text", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    return brown.score_texts(docs)


def op5_html_text(spark: SparkSession, base: str) -> DataFrame:
    found = htmlmain.main_text(table(spark, base, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_exact_dedup(spark: SparkSession, base: str) -> DataFrame:
    return exactdup.exact_groups(documents(spark, base))


def op7_substring_dedup(spark: SparkSession, base: str) -> DataFrame:
    return substring.passages(documents(spark, base))


def op8_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, base).select("doc_id", "text"), table(spark, base, "benchmark", "item_id", "text"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base).select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labels = table(spark, base, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(docs.where(~F.col("held_out")), labels)
    return toxicity.score_texts(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_quality(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base).select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    described = checkpointed(quality.describe(docs))
    labels = table(spark, base, "labels", "doc_id", "quality").where(~held_out(F.col("doc_id"), 4, 2))
    return quality.score(described, quality.train(described, labels)).select("doc_id", "held_out", "score", "predicted")


def op12_importance_resample(spark: SparkSession, base: str) -> DataFrame:
    drawn = resample.resample(table(spark, base, "documents", "doc_id", "text"), table(spark, base, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, base: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, base, "embeddings"))


QUERIES = {"op1_packing": op1_packing, "op3_near_dedup": op3_near_dedup, "op4_lm_scoring": op4_lm_scoring, "op5_html_text": op5_html_text, "op6_exact_dedup": op6_exact_dedup, "op2_line_dedup": op2_line_dedup, "op7_substring_dedup": op7_substring_dedup, "op8_decontaminate": op8_decontaminate, "op9_toxicity": op9_toxicity, "op10_language_id": op10_language_id, "op11_quality": op11_quality, "op12_importance_resample": op12_importance_resample, "op13_vector_codes": op13_vector_codes}

