"""Books: pages from files, bibliographies from XML, and searches over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["Category", "Title", "Authors", "CreatedYear", "Publishers", "Location", "StartPage", "CurrentPage", "ISBN", "Additional", "ImageFileLocation", "Keywords"]
SEPARATOR = "###"


def _place(rows: DataFrame) -> DataFrame:
    parts = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    return rows.withColumns({"book": F.element_at(parts, -2), "page": F.element_at(parts, -1).try_cast("int")}).where("page is not null")


def read_pages(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(book, page, text): a file a page, named by its number, in a folder named by its book; others are left out."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return _place(rows).select("book", "page", "text")


def read_images(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(book, page, image)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return _place(rows).select("book", "page", F.col("content").alias("image"))


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """One row a Bibliography element, a text column a field."""
    schema = ", ".join(f"`{f}` string" for f in FIELDS)
    return spark.read.format("xml").option("rowTag", "Bibliography").schema(schema).load(path)


def triples(books: DataFrame, id_col: str) -> DataFrame:
    """(value): id, field and value between ###, without values that aren't available."""
    fields = [f for f in FIELDS if f in books.columns]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("v")) for f in fields)))
    rows = books.select(F.col(id_col).cast("string").alias("id"), pairs.alias("p")).where("p.v is not null and p.v not in ('', 'N/A')")
    return rows.select(F.concat_ws(SEPARATOR, "id", "p.field", "p.v").alias("value"))


def read_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, field, value) from such lines."""
    part = F.split(column, SEPARATOR)
    return lines.where(F.size(part) == 3).select(F.get(part, F.lit(0)).alias("id"), F.get(part, F.lit(1)).alias("field"), F.get(part, F.lit(2)).alias("value"))
