"""Generated benchmark corpus: numbered sections that cycle through short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURATORS = ("Ines Halvorsen", "Tomasz Brandt", "Yuki Calloway", "Rosa Whitlock", "Farid Lindqvist", "Oona Pereira")
MUSEUMS = ("Harbour Museum", "Mill Street Gallery", "Copperfield Archive", "Old Observatory")
TOWNS = ("Tromso", "Valencia", "Kumasi", "Dunedin", "Plovdiv")
OBJECTS = ("sundial", "tapestry", "ship model", "printing press", "star chart")
CRAFTS = ("bookbinding", "glass blowing", "rope making")
FIRST_YEAR, YEARS = 1870, 120
SECTION = (
    "Entry %d. %s of the %s bought a %s in %s in %d. The piece shows how %s was taught there. "
    "%s later lent it to the %s, where %s wrote its catalogue. "
)


def sections(spark: SparkSession, count: int) -> DataFrame:
    """(section, text, words), made on the executors."""

    def cycle(values: tuple[str, ...], shift: int = 0):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("id") + shift, F.lit(len(values))) + 1).cast("int"))

    year = (F.lit(FIRST_YEAR) + F.pmod(F.col("id"), F.lit(YEARS))).cast("int")
    museum, curator = cycle(MUSEUMS), cycle(CURATORS)
    values = (curator, museum, cycle(OBJECTS), cycle(TOWNS), year, cycle(CRAFTS), museum, cycle(MUSEUMS, 1), cycle(CURATORS, 2))
    text = F.format_string(SECTION, F.col("id"), *values)
    words = F.size(F.split(F.trim(text), " +"))
    return spark.range(count).select(F.col("id").alias("section"), text.alias("text"), words.alias("words"))


def corpus(spark: SparkSession, words: int, per_document: int = 20) -> DataFrame:
    """Documents of `per_document` sections with about `words` words in all: (doc_id, text)."""
    average = sections(spark, 100).agg(F.avg("words")).first()[0]
    rows = sections(spark, int(words / average) + 1).withColumn("doc_id", F.floor(F.col("section") / per_document))
    ordered = F.array_sort(F.collect_list(F.struct("section", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("text"))
