"""Extra tags for an entry: what its posts have and its prompt lacks, by class, and the prompt with them in class order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import comma_tags, compare_form, query_form, strip
from tagsieve.operators import taglist

#: Category codes in the order in which their tags are applied.
CLASSES = (4, 3, 0, 1, 5)


def profile_lists(profiles: DataFrame) -> DataFrame:
    """(seed_tag, tags): the profile of each seed as one array of (tag, category) in profile order; profiles are capped by their makers."""
    grouped = profiles.groupBy("seed_tag").agg(F.array_sort(F.collect_list(F.struct("place", "tag", "category"))).alias("x"))
    return grouped.select("seed_tag", F.transform("x", lambda t: F.struct(t["tag"].alias("tag"), F.when(t["category"].isin(*CLASSES), t["category"]).otherwise(0).alias("category"))).alias("tags"))


def _named(tags: Column, category: int) -> Column:
    return F.transform(F.filter(tags, lambda t: t["category"] == category), lambda t: t["tag"])


def fetch(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, c4, c3, c0, c1, c5, total, categories) of the entries (id, seed, series, prompt) whose seed has a profile.

    Left out is what the prompt has: it is lower-cased and split at commas, its ``_`` stay. The seed is put in front of the
    characters and the series in front of the series unless they are there or in the prompt. Each list holds one of every
    group of equal compare forms. ``categories`` maps compare forms to their class. Entries without a seed or with a seed
    without profile have no row. The lists join by seed; Catalyst sends them to the entries where they are small.
    """
    kept = entries.select("id", strip("seed").alias("_seed"), F.coalesce("series", F.lit("")).alias("_series"), "prompt").where(F.col("_seed") != "")
    joined = kept.join(lists.withColumnRenamed("seed_tag", "_key"), query_form("_seed") == F.col("_key"))
    present = F.split(F.lower(strip(F.coalesce("prompt", F.lit("")))), r",(?U)\s*")
    staged = joined.withColumn("_present", present)
    clean = F.filter("tags", lambda t: (compare_form(t["tag"]) != "") & ~F.array_contains("_present", compare_form(t["tag"])))
    staged = staged.withColumn("_tags", clean)
    staged = staged.withColumn("_known", F.transform("_tags", lambda t: compare_form(t["tag"])))
    add_seed = ~F.array_contains("_known", compare_form("_seed")) & ~F.array_contains("_present", compare_form("_seed"))
    staged = staged.withColumn("_add_seed", add_seed)
    same = F.col("_add_seed") & (compare_form("_series") == compare_form("_seed"))
    add_series = (F.col("_series") != "") & ~F.array_contains("_known", compare_form("_series")) & ~F.array_contains("_present", compare_form("_series")) & ~same
    staged = staged.withColumn("_add_series", add_series)
    none = F.array().cast("array<string>")
    heads = {4: F.when(F.col("_add_seed"), F.array("_seed")).otherwise(none), 3: F.when(F.col("_add_series"), F.array("_series")).otherwise(none)}
    made = {f"c{k}": taglist.unique(F.concat(heads[k], _named(F.col("_tags"), k)) if k in heads else _named(F.col("_tags"), k)) for k in CLASSES}
    # Of equal forms in several classes the last one counts, as in a dictionary that is written in order.
    pairs = F.concat(
        F.transform("_tags", lambda t: F.struct(compare_form(t["tag"]).alias("key"), t["category"].alias("value"))),
        F.when(F.col("_add_seed"), F.array(F.struct(compare_form("_seed").alias("key"), F.lit(4).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:int>>")),
        F.when(F.col("_add_series"), F.array(F.struct(compare_form("_series").alias("key"), F.lit(3).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:int>>")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    out = staged.select("id", "prompt", *[c.alias(n) for n, c in made.items()], F.map_from_arrays(keys, last).alias("categories"))
    return out.withColumn("total", sum(F.size(c) for c in made))


def apply_selected(fetched: DataFrame) -> DataFrame:
    """(id, prompt, added) for rows of fetch, all their tags selected: new ones behind the prompt's, then all in class order.

    A row without extra tags keeps its prompt as it stands.
    """
    have = comma_tags("prompt")
    staged = fetched.withColumn("_have", have).withColumn("_all", taglist.append_unique("_have", F.concat(*[f"c{k}" for k in CLASSES])))
    ordered = F.array_join(taglist.ordered_by("_all", F.col("categories")), ", ")
    return staged.select("id", F.when(F.col("total") == 0, F.col("prompt")).otherwise(ordered).alias("prompt"), (F.size("_all") - F.size("_have")).alias("added"))
