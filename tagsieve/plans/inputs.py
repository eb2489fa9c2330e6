"""The driver's tables as frames; missing columns of older files are added as NULL by the callers that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions.text import source_key
from tagsieve.operators.packed import either, explode_packed, known_pattern, known_values, shaped_pattern, with_packed_values
from tagsieve.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _known(spark: SparkSession, sf_dir: str) -> list[str]:
    tags = table(spark, sf_dir, "danbooru_tags").select("tag")
    names = table(spark, sf_dir, "tag_aliases").select("antecedent_name")
    return known_values(tags, names)


def known_in_dictionary(spark: SparkSession, sf_dir: str) -> str | None:
    """Pattern of the dictionary's own tags and alias names that contain separating marks (a fixed, size-checked list)."""
    return known_pattern(_known(spark, sf_dir))


def tag_lists(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of characters, tags and ``vals``, the values of tags."""
    rows = spread(table(spark, sf_dir, "characters").select(*columns, "tags", source_key("source").alias("_from")))
    return with_packed_values(rows, "tags", "vals", known_in_dictionary(spark, sf_dir), source_col="_from").drop("_from")


def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, pos, val) of characters.tags."""
    rows = spread(table(spark, sf_dir, "characters").select("id", "tags", source_key("source").alias("_source")))
    return explode_packed(rows, "id", "tags", known_in_dictionary(spark, sf_dir), "_source")


def alias_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, pos, val) of danbooru_tags.aliases; alias names missing from the alias table are known by their shape."""
    known = _known(spark, sf_dir)
    pattern = either(known_pattern(known), shaped_pattern(known))
    return explode_packed(table(spark, sf_dir, "danbooru_tags"), "line_no", "aliases", pattern)


def aliases_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, alias) of the dictionary."""
    lines = table(spark, sf_dir, "danbooru_tags").select(F.col("line_no").alias("rec_id"), "tag")
    return alias_values(spark, sf_dir).join(lines, "rec_id").select("tag", F.col("val").alias("alias"))
