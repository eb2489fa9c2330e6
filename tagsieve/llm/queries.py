"""Queries of the llm operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions.text import blank, plain_form
from tagsieve.llm import canonical, cooccur, copies, leakage, sentences, termfreq, tokenize, truncation
from tagsieve.plans.inputs import aliases_of_tags, table, tag_lists
from tagsieve.session import spread, written


def _mapped(spark: SparkSession, sf_dir: str, with_value: bool = False) -> DataFrame:
    tags = table(spark, sf_dir, "danbooru_tags").select("tag", "category", "post_count", "line_no")
    entries = canonical.canonical_entries(tags, aliases_of_tags(spark, sf_dir), table(spark, sf_dir, "tag_aliases"))
    rows = spread(table(spark, sf_dir, "characters").select("id", "name", "series", "danbooru_tag"))
    return canonical.map_values(rows, "id", ["name", "series", "danbooru_tag"], "series", entries, with_value)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary tag of every name, series and danbooru_tag."""
    return _mapped(spark, sf_dir)


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that the dictionary does not hold, with its field and the number of rows that have it."""
    return _mapped(spark, sf_dir, True).where(F.col("tag") == "").groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def _cut_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tag_lists(spark, sf_dir, "id", "source").select("id", "source", F.col("tags").alias("text"), "vals")
    dictionary = table(spark, sf_dir, "danbooru_tags").select(plain_form("tag").alias("term"))
    return truncation.cut_scores(records, dictionary)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose tags were cut."""
    return _cut_scores(spark, sf_dir).where(F.col("score") > 0.5).select("id")


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, cut rows and their share for each source."""
    cut = F.sum((F.col("score") > 0.5).cast("long"))
    grouped = _cut_scores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), cut.alias("cut_rows"))
    return grouped.withColumn("share", F.round(F.col("cut_rows") / F.col("rows"), 6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of listings that agree in source, name words and tag set."""
    kept = tag_lists(spark, sf_dir, "id", "source", "name").where(~blank("tags"))
    return copies.copy_members(written(copies.encoded_records(kept)))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing once, with its number of copies."""
    kept = tag_lists(spark, sf_dir, "id", "source", "name").where(~blank("tags"))
    return copies.copy_groups(copies.encoded_records(kept)).select("first_id", "copies")


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.transform("vals", lambda v: plain_form(v)))
    return written(tag_lists(spark, sf_dir, "id").select(F.filter(terms, lambda t: t != "").alias("items")))


def p5_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags in at least 5 rows and one row in 2,000, with their surprise under the configuration null."""
    baskets = _baskets(spark, sf_dir)
    n = baskets.count()
    return cooccur.pair_surprise(baskets, max(5, -(-n // 2000))).withColumn("n", F.lit(n).cast("long"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of p5_surprise those at least three times as frequent as for independent tags."""
    pairs = p5_surprise(spark, sf_dir)
    lifted = F.col("n_ab") * F.col("n") >= F.lit(3).cast("long") * F.col("n_a") * F.col("n_b")
    return pairs.where(lifted).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and rows of every tag and every series, with their mark where they have one."""
    rows = table(spark, sf_dir, "characters").select("id", "series")
    tags = tag_lists(spark, sf_dir, "id").select(F.lit("tags").alias("field"), F.explode_outer("vals").alias("term"), F.col("id").alias("rec_id"))
    series = rows.select(F.lit("series").alias("field"), F.col("series").alias("term"), F.col("id").alias("rec_id"))
    pairs = tags.unionByName(series).withColumn("term", plain_form("term"))
    found = termfreq.term_frequencies(pairs)
    return found.withColumn("mark", termfreq.usefulness(F.col("records"), F.lit(rows.count())))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p6_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize.encode_texts(spread(documents), "doc_id", "text", tokenize.vocabulary())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return leakage.leaks(spread(documents), "doc_id", "text", items).select("item_id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return sentences.split_sentences(spread(documents), "doc_id", "text", "lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_unmatched": p1_unmatched,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p2_found": p2_found,
    "p2_sources": p2_sources,
    "p3_found": p3_found,
    "p3_copies": p3_copies,
    "p5_found": p5_found,
    "p5_surprise": p5_surprise,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_ids": p7_ids,
}
ORACLES: dict[str, str] = {}
