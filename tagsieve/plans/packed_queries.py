"""Queries of the operator on packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions.text import source_key
from tagsieve.operators.packed import delimiter_profile
from tagsieve.plans.inputs import alias_values, known_in_dictionary, table, tag_values
from tagsieve.session import spread


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each value of characters.tags and danbooru_tags.aliases, with its position."""
    columns = ["field", "rec_id", "pos", "val"]
    tags = tag_values(spark, sf_dir).withColumn("field", F.lit("tags")).select(columns)
    aliases = alias_values(spark, sf_dir).withColumn("field", F.lit("aliases")).select(columns)
    return tags.unionByName(aliases)


def p4_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the records of each source separate the values of their tags."""
    rows = spread(table(spark, sf_dir, "characters").select(source_key("source").alias("source"), "tags"))
    return delimiter_profile(rows, "source", "tags", known_in_dictionary(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_delimiters": p4_delimiters}
