"""Knowledge-base inputs derived from the given tables; each function has its SQL twin in `sql`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.operators import chunks as ch
from lorefield.operators import extract as ex
from lorefield.operators import manifest as mf
from lorefield.functions.text import casefold, content_hash, py_strip
from lorefield.session import apply_semantics, in_even_parts, table

EXTENSION_BY_LANG = {"en": ".txt", "fr": ".md", "de": ".PDF", "es": ".docx"}
BASE_TIME = "2024-01-01 00:00:00"


def documents(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    apply_semantics(spark)
    return table(spark, base, "documents", *(columns or ("doc_id", "text")))


def file_name():
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSION_BY_LANG.items() for x in pair])
    return F.concat("source", F.coalesce(F.try_element_at(kinds, "lang"), F.lit("")))


FILE_NAME_SQL = (
    "source || CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSION_BY_LANG.items()) + " ELSE '' END"
)


def incoming(spark: SparkSession, base: str) -> DataFrame:
    """Every document as an upload, in doc_id order."""
    docs = documents(spark, base, "doc_id", "text", "lang", "source")
    return docs.select(
        F.col("doc_id").alias("seq"), file_name().alias("file_name"), mf.source_type_of(file_name()).alias("source_type"), "text"
    )


def date_added(doc):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(BASE_TIME).cast("timestamp")) + doc * 60)


DATE_SQL = f"TIMESTAMP '{BASE_TIME}' + to_minutes(CAST(doc_id AS INTEGER))"
TYPE_SQL = (
    "CASE lower(regexp_extract({0}, '(\\.[^.]*)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.md' THEN 'markdown' "
    "WHEN '.markdown' THEN 'markdown' WHEN '.txt' THEN 'text' END"
)


def stored_manifest(spark: SparkSession, base: str) -> DataFrame:
    """Labelled documents of good quality count as stored already."""
    docs = documents(spark, base, "doc_id", "text", "lang", "source")
    labels = table(spark, base, "labels", "doc_id", "quality").where("quality = 1")
    stored = docs.join(labels, "doc_id", "left_semi")
    text = py_strip(F.col("text"))
    return stored.select(
        F.concat(F.lit("kb-"), F.col("doc_id")).alias("doc_id"),
        file_name().alias("file_name"),
        F.coalesce(mf.source_type_of(file_name()), F.lit("unknown")).alias("source_type"),
        content_hash(text).alias("content_hash"),
        F.lit(1).alias("chunk_count"),
        F.octet_length(text).cast("long").alias("size_bytes"),
        date_added(F.col("doc_id")).alias("date_added"),
    )


def doc_status(spark: SparkSession, base: str) -> DataFrame:
    """Index status: good labels are processed, bad ones failed, the rest pending; plus one tombstone per failure."""
    docs = documents(spark, base, "doc_id", "lang", "source", "n_chars")
    labels = table(spark, base, "labels", "doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left").withColumn("name", file_name())
    main = joined.select(
        F.concat(F.lit("kb-"), F.col("doc_id")).alias("id"),
        F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "failed").otherwise("pending").alias("status"),
        F.when(F.col("lang") == "es", "").otherwise(F.col("name")).alias("file_path"),
        F.lit(None).cast("int").alias("chunks_count"),
        F.when(F.col("lang") == "en", F.md5("name")).alias("content_hash"),
        F.col("n_chars").alias("content_length"),
        F.lit(None).cast("string").alias("error_msg"),
    )
    stones = joined.where("quality = 0").select(
        F.concat(F.lit("dup-"), F.col("doc_id")).alias("id"),
        F.lit("failed").alias("status"),
        F.col("name").alias("file_path"),
        F.lit(None).cast("int").alias("chunks_count"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("long").alias("content_length"),
        F.lit("File name already exists.").alias("error_msg"),
    )
    return main.unionByName(stones)


def unique_documents(spark: SparkSession, base: str) -> DataFrame:
    """First document of every content hash, texts included. Only ids and hashes are aggregated."""
    docs = documents(spark, base)
    hashed = docs.select("doc_id", content_hash(py_strip(F.col("text"))).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi")


def chunk_rows(spark: SparkSession, base: str) -> DataFrame:
    return ch.chunk_by_tokens(unique_documents(spark, base))


def chunk_records(spark: SparkSession, base: str) -> DataFrame:
    return ex.extract_records(chunk_rows(spark, base)).drop("token_count")


def mention_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = ex.entity_rows(chunk_records(spark, base), "doc_id", "chunk_index", "chunk_id")
    return rows.withColumn("key", casefold(F.col("name")))


def pair_rows(spark: SparkSession, base: str) -> DataFrame:
    rows = ex.relationship_rows(chunk_records(spark, base), "doc_id", "chunk_index")
    return rows.withColumns({"source_key": casefold(F.col("source")), "target_key": casefold(F.col("target"))})


def trade_edges(spark: SparkSession, base: str) -> DataFrame:
    """Typed graph over the relational tables: customers, parts, suppliers, nations, regions."""

    def node(kind: str, key: str):
        return F.concat(F.lit(f"{kind}:"), F.col(key))

    def located(name: str, kind: str, key: str, nation: str) -> DataFrame:
        return table(spark, base, name, key, nation).select(
            node(kind, key).alias("src"), node("nation", nation).alias("dst"), F.lit("located_in").alias("relation"), F.lit(1.0).alias("weight")
        )

    lines = table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, base, "orders", "o_orderkey", "o_custkey")
    nations = table(spark, base, "nation", "n_nationkey", "n_regionkey").select(
        node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("weight")
    )
    size = lines.count()
    ordered = in_even_parts(orders, size, "o_orderkey").join(in_even_parts(lines, size, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # Hardly a pair comes twice in one task, so nothing is gained by counting before the rows are dealt by pair.
    bought = (
        in_even_parts(ordered.select("o_custkey", "l_partkey"), size, "o_custkey", "l_partkey")
        .groupBy("o_custkey", "l_partkey")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select(node("customer", "o_custkey").alias("src"), node("part", "l_partkey").alias("dst"), F.lit("bought").alias("relation"), "weight")
    )
    supplied = (
        in_even_parts(lines.select("l_partkey", "l_suppkey"), size, "l_partkey", "l_suppkey")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("relation"), "weight")
    )
    return (
        located("customer", "customer", "c_custkey", "c_nationkey")
        .unionByName(located("supplier", "supplier", "s_suppkey", "s_nationkey"))
        .unionByName(nations)
        .unionByName(bought)
        .unionByName(supplied)
    )


def trade_nodes(spark: SparkSession, base: str) -> DataFrame:
    """(id, entity_type, seq) of every node of the typed graph."""

    def nodes(name: str, kind: str, key: str) -> DataFrame:
        return table(spark, base, name, key).select(
            F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("seq")
        )

    out = nodes("customer", "customer", "c_custkey")
    for name, kind, key in (("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("nation", "nation", "n_nationkey"), ("region", "region", "r_regionkey")):
        out = out.unionByName(nodes(name, kind, key))
    return out
