"""Readers of the formats the catalog comes in: Parquet, dictionary CSV, JSON lists and posts, listing pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsieve.operators.catalog import with_default_source
from tagsieve.operators.dictionary import load

CATALOG = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("series", T.StringType()), T.StructField("tags", T.StringType()),
    T.StructField("image_url", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("danbooru_tag", T.StringType()), T.StructField("source", T.StringType()),
])
POSTS = "post_id long, tag_string_general string, tag_string_character string, tag_string_copyright string, tag_string string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog from Parquet; columns that older files lack are added."""
    return with_default_source(spark.read.parquet(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary from CSV with a header; names are stripped and lower-cased, ``name`` and ``tag_aliases`` are accepted too.

    Numbers that cannot be read make both 0. Quoted values may hold line breaks, so a file is read by one task and its lines
    keep their order. A missing file gives no rows.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "tag string, category string, post_count string, aliases string")
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    for wanted, other in (("tag", "name"), ("aliases", "tag_aliases"), ("category", None), ("post_count", None)):
        if wanted not in raw.columns:
            raw = raw.withColumn(wanted, F.col(other) if other in raw.columns else F.lit(None).cast("string"))
    typed = raw.select(
        F.monotonically_increasing_id().alias("line_no"), "tag", F.expr("try_cast(trim(category) AS INT)").alias("category"),
        F.expr("try_cast(trim(post_count) AS BIGINT)").alias("post_count"), "aliases",
    )
    return load(typed)


def read_posts(spark: SparkSession, path: str, further: str = "") -> DataFrame:
    """Landed JSON records of posts, with a fixed schema and ``further`` columns; fields that are absent are NULL."""
    return spark.read.schema(f"{POSTS}, {further}" if further else POSTS).json(path)


def parse_id_list(c: str) -> F.Column:
    """Favorites from a JSON array: whole numbers and digit strings stay, other elements go; broken text is empty."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.transform(F.filter(items, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))


def parse_text_list(c: str) -> F.Column:
    """History from a JSON array: blank elements go; broken text is empty."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False)))


def parse_overrides(c: str) -> F.Column:
    """Overrides from a JSON object of id to tag."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, html) of a folder of files named by their page number."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_name").alias("file"))
    return files.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("page"), "html")
