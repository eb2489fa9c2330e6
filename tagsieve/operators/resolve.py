"""Resolution of names to canonical tags by a cascade of keys and stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.functions.text import STOP_WORDS_SHORT, inverted, meaningful_words, query_form, suffix, unescape_brackets, without_suffix
from tagsieve.operators.dictionary import redirect
from tagsieve.session import written

#: Tags that a search for a key brings.
MOST_CANDIDATES = 20
#: Order of the keys; a smaller number is tried first.
ORDER = ["full", "inverted", "base", "series_alias", "series_alias_inv"]


def keys(names: DataFrame, redirects: DataFrame) -> DataFrame:
    """(id, prio, label, key) of the names (id, name): the whole name, its words exchanged, without the bracketed series,
    and with the series under its canonical name. Empty keys are left out."""
    base = names.where(F.col("name").isNotNull()).select("id", unescape_brackets("name").alias("n"))
    staged = base.select("id", "n", without_suffix("n").alias("b"), suffix("n").alias("s")).withColumn("i", inverted("b"))
    canonical = redirect(staged.withColumn("series", query_form("s")), redirects, "series")
    series = F.concat(F.lit("_("), F.col("series"), F.lit(")"))
    has = (F.col("b") != F.col("n")) & (F.col("s") != "")
    none = F.lit(None).cast("string")
    made = {
        "full": query_form("n"),
        "inverted": query_form("i"),
        "base": F.when(F.col("b") != F.col("n"), query_form("b")).otherwise(none),
        "series_alias": F.when(has, F.concat(query_form("b"), series)).otherwise(none),
        "series_alias_inv": F.when(has & (F.col("i") != ""), F.concat(query_form("i"), series)).otherwise(none),
    }
    listed = F.array(*(F.struct(F.lit(k).alias("prio"), F.lit(label).alias("label"), made[label].alias("key")) for k, label in enumerate(ORDER)))
    return canonical.select("id", F.inline(listed)).where(F.col("key") != "")


def by_dictionary(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """(id, tag, strategy): the first key that the alias index (key, canonical) holds."""
    hits = keyed.join(index, "key").select("id", F.struct("prio", "label", "canonical").alias("h")).groupBy("id").agg(F.min("h").alias("h"))
    return hits.select("id", F.replace("h.canonical", F.lit("_"), F.lit(" ")).alias("tag"), F.concat(F.lit("csv:"), F.col("h.label")).alias("strategy"))


def by_posts(names: DataFrame, keyed: DataFrame, seed_tags: DataFrame, index: DataFrame) -> DataFrame:
    """(id, tag, strategy): the first key that posts were fetched for, with its most frequent character tag that shares a
    word with the name and that the index knows. ``seed_tags`` has seed, raw_tag, count, first."""
    words = names.where(F.col("name").isNotNull()).select("id", meaningful_words(unescape_brackets("name"), STOP_WORDS_SHORT).alias("words"))
    pairs = keyed.join(seed_tags.withColumnRenamed("seed", "key"), "key").join(words, "id")
    fitting = pairs.where(F.arrays_overlap(meaningful_words("raw_tag", STOP_WORDS_SHORT), F.col("words")))
    best = fitting.groupBy("id", "prio", "label").agg(F.min_by("raw_tag", F.struct(-F.col("count"), F.col("first"))).alias("raw_tag"))
    known = best.join(index.select(F.col("key").alias("raw_tag"), "canonical"), "raw_tag")
    hits = known.groupBy("id").agg(F.min(F.struct("prio", "label", "canonical")).alias("h"))
    return hits.select("id", F.replace("h.canonical", F.lit("_"), F.lit(" ")).alias("tag"), F.col("h.label").alias("strategy"))


def candidates_of(keyed: DataFrame, tags: DataFrame) -> DataFrame:
    """(key, raw_tag, post_count): for each key the MOST_CANDIDATES most used of the tags (tag, post_count) that contain it.

    Every part of a tag whose length some key has meets the keys in an equi-join; a part that no key equals goes no further.
    """
    wanted = keyed.select("key").where(F.col("key") != "").distinct()
    lengths = [r[0] for r in wanted.select(F.length("key")).distinct().collect()]  # whole numbers, at most the longest key
    whole = tags.select(F.lower("tag").alias("_t"), F.col("tag").alias("raw_tag"), F.coalesce("post_count", F.lit(0)).alias("post_count"))
    fitting = F.filter(F.from_json(F.lit(str(sorted(lengths))), "array<int>"), lambda n: n <= F.length("_t"))
    parts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda at: F.substring(F.col("_t"), at, n))))
    each = whole.select("raw_tag", "post_count", F.explode(F.array_distinct(parts)).alias("key"))
    order = Window.partitionBy("key").orderBy(F.desc("post_count"), "raw_tag")
    return each.join(wanted, "key", "left_semi").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= MOST_CANDIDATES).drop("_k")


def by_tag_search(names: DataFrame, keyed: DataFrame, tags: DataFrame, index: DataFrame) -> DataFrame:
    """(id, tag, strategy): the first key with a candidate that shares words with the name and does not contradict its series.

    Of a key's candidates the one with most common words wins, then most posts, then the last by letters; one whose
    bracketed series has no word in common with the name's is refused, and so is one that the index does not know. The key
    without the series is left out where the name has a series and a single word.
    """
    own = names.where(F.col("name").isNotNull()).select("id", unescape_brackets("name").alias("n"))
    own = own.select("id", *(meaningful_words(c, STOP_WORDS_SHORT).alias(k) for k, c in (("w", F.col("n")), ("sw", suffix("n")), ("bw", without_suffix("n")))))
    joined = keyed.join(candidates_of(keyed, tags), "key").join(own, "id").where(~((F.col("label") == "base") & (F.size("sw") > 0) & (F.size("bw") < 2)))
    joined = joined.withColumn("cw", meaningful_words(suffix("raw_tag"), STOP_WORDS_SHORT)).withColumn("overlap", F.size(F.array_intersect(meaningful_words("raw_tag", STOP_WORDS_SHORT), F.col("w"))))
    compatible = (F.size("sw") == 0) | (F.size("cw") == 0) | F.arrays_overlap("sw", "cw")
    best = joined.where((F.col("overlap") > 0) & compatible).groupBy("id", "prio", "label").agg(F.max_by("raw_tag", F.struct("overlap", "post_count", "raw_tag")).alias("raw_tag"))
    known = best.withColumn("key", F.lower("raw_tag")).join(index, "key")
    hits = known.groupBy("id").agg(F.min(F.struct("prio", "label", "canonical")).alias("h"))
    return hits.select("id", F.replace("h.canonical", F.lit("_"), F.lit(" ")).alias("tag"), F.concat(F.lit("tag_search:"), F.col("h.label")).alias("strategy"))


def cascade(names: DataFrame, keyed: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(id, tag, strategy) of every name from the first stage that has it; '' and not_found where none has.

    A stage takes the keys of the names that are left. What it finds is written before the next one starts.
    """
    rest, out = names.select("id"), None
    for stage in stages:
        hit = written(rest.join(stage(keyed), "id"))
        out = hit if out is None else out.unionByName(hit)
        rest, keyed = (df.join(hit.select("id"), "id", "left_anti") for df in (rest, keyed))
    lost = rest.select("id", F.lit("").alias("tag"), F.lit("not_found").alias("strategy"))
    return lost if out is None else out.unionByName(lost)


def strategy_counts(resolved: DataFrame) -> DataFrame:
    """Names by strategy, with the share that the dictionary answered."""
    return resolved.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("strategy").startswith("csv:").cast("int")).alias("from_dictionary"))
