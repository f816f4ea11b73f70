"""Multi-file uploads: read, type, decode; a bad file becomes an error row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.text import falsy, py_strip
from lorefield.operators.manifest import extension, source_type_of

# --- fixed values ---
ACCEPTED_GLOB = "*.{pdf,md,markdown,txt}"
DEFAULT_NAME = "untitled"
# --------------------

NO_PDF_READER = "No PDF reader is installed."


def list_files(spark: SparkSession, path: str, accepted_only: bool = False) -> DataFrame:
    """(path, file_name, content) of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if accepted_only:
        reader = reader.option("pathGlobFilter", ACCEPTED_GLOB)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return reader.load(path).select("path", falsy(name, F.lit(DEFAULT_NAME)).alias("file_name"), "content")


def decode_text(content: Column) -> Column:
    """UTF-8 text; invalid bytes become the replacement character instead of failing the job."""
    return py_strip(F.make_valid_utf8(content.cast("string")))


def _pdf_text(data: bytes) -> tuple[str | None, str | None]:
    try:
        import fitz
    except ImportError:
        return None, NO_PDF_READER
    try:
        with fitz.open(stream=data, filetype="pdf") as doc:
            return "\n\n".join(page.get_text() for page in doc).strip(), None
    except Exception as e:  # one unreadable file must not stop the batch
        return None, str(e)


def pdf_text_udf():
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pdf_text(c) for c in content], columns=["text", "error"])

    return run


def parse_files(files: DataFrame, pdf_reader=None) -> DataFrame:
    """(path, file_name, source_type, text, error). Only PDF rows go through Python."""
    typed = files.withColumn("source_type", source_type_of(F.col("file_name")))
    reader = pdf_reader or pdf_text_udf()
    pdfs = (
        typed.where(F.col("source_type") == "pdf")
        .withColumn("_r", reader(F.col("content")))
        .select("path", "file_name", "source_type", F.col("_r.text").alias("text"), F.col("_r.error").alias("error"))
    )
    none = F.lit(None).cast("string")
    texts = typed.where(F.col("source_type").isin("markdown", "text")).select(
        "path", "file_name", "source_type", decode_text(F.col("content")).alias("text"), none.alias("error")
    )
    refused = typed.where(F.col("source_type").isNull()).select(
        "path",
        "file_name",
        "source_type",
        none.alias("text"),
        F.concat(F.lit("Unsupported file type: "), extension(F.col("file_name"))).alias("error"),
    )
    return texts.unionByName(pdfs).unionByName(refused)


def transcript_text(snippets: DataFrame) -> DataFrame:
    """English video transcripts from (video_id, lang, pos, text); an empty one is an error row."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    text = py_strip(F.array_join(F.transform(ordered, lambda s: s["text"]), " "))
    joined = snippets.where(F.col("lang") == "en").groupBy("video_id").agg(text.alias("text"))
    missing = F.concat(F.lit("No transcript available for video: "), F.col("video_id"))
    return joined.withColumn("error", F.when(F.col("text") == "", missing))
