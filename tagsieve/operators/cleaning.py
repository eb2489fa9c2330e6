"""Cleaning of names and series, repair of cut tag lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import strip, title

#: Last bracketed words that name a medium, not a series. Fixed values.
MEDIA = ["game", "series", "anime", "manga", "utaite", "novel", "visual novel", "movie", "cosplay", "vtuber", "character"]
SHORTEST_PREFIX, SHORTEST_KEPT, TRUSTED_POSTS = 3, 3, 500


def clean_series(rows: DataFrame) -> DataFrame:
    """Add new_name and new_series to rows with name, series and tags.

    A missing series is taken from the second comma part of tags. The last bracketed group of the series is the true
    series unless it names a medium; the group before it goes to the name. Without brackets only the title is written.
    """
    second = F.get(F.split("tags", ","), 1)
    from_tags = (F.coalesce("series", F.lit("")) == "") & (F.coalesce("tags", F.lit("")) != "") & second.isNotNull()
    staged = rows.withColumn("_s", F.when(from_tags, title(strip(second))).otherwise(F.col("series")))
    staged = staged.withColumn("_clean", F.replace("_s", F.lit("\\"), F.lit(""))).withColumn("_bare", F.replace("name", F.lit("\\"), F.lit("")))
    staged = staged.withColumn("_groups", F.regexp_extract_all("_clean", F.lit(r"\(([^)]+)\)"), F.lit(1)))
    base = title(strip(F.regexp_replace("_bare", r"(?U)\s*\([^)]+\)", "")))
    last = F.element_at("_groups", -1)
    medium = F.lower(strip(last)).isin(MEDIA)
    named = F.when(F.size("_groups") >= 2, F.concat(base, F.lit(" ("), title(F.get("_groups", F.size("_groups") - 2)), F.lit(")"))).otherwise(base)
    named = F.when(F.length(named) < 2, F.col("name")).otherwise(named)
    named = F.when(named.contains(")") & ~named.contains("("), F.replace(named, F.lit(")"), F.lit(""))).otherwise(named)
    series = F.when(medium, title(strip(F.split_part("_clean", F.lit("("), F.lit(1))))).otherwise(title(last))
    empty = F.coalesce("_s", F.lit("")) == ""
    plain = F.size("_groups") == 0
    return staged.select(
        *rows.columns,
        F.when(empty | plain, F.col("name")).otherwise(named).alias("new_name"),
        F.when(empty, F.col("_s")).when(plain, title(strip("_s"))).otherwise(series).alias("new_series"),
    )


def completions(dictionary: DataFrame) -> DataFrame:
    """(partial, completion) for every proper prefix of a trusted tag: a tag that goes on at a word end wins, then count, then tag."""
    tags = dictionary.select(F.lower(F.replace("tag", F.lit("_"), F.lit(" "))).alias("t"), "post_count").groupBy("t").agg(F.max("post_count").alias("n"))
    trusted = tags.where((F.col("n") >= TRUSTED_POSTS) & (F.length("t") > SHORTEST_PREFIX))
    each = trusted.select("t", "n", F.explode(F.sequence(F.lit(SHORTEST_PREFIX), F.length("t") - 1)).alias("k"))
    keyed = each.select(F.expr("substring(t, 1, k)").alias("partial"), F.struct(F.expr("substring(t, k + 1, 1)").isin(" ", "(", ")").cast("int").alias("edge"), F.col("n"), F.col("t")).alias("s"))
    return keyed.groupBy("partial").agg(F.max("s").getField("t").alias("completion"))


def repair_tags(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, tags, fixed, action) with action ok, strip_comma, completed or removed for the last tag of a comma list.

    Prefixes of the dictionary are an equi-join, never a comparison of every pair.
    """
    valid = dictionary.select(F.lower(F.replace("tag", F.lit("_"), F.lit(" "))).alias("_last")).distinct().withColumn("_valid", F.lit(True))
    right = F.regexp_replace("tags", r"(?U)\s+$", "")
    staged = rows.select("id", "tags", right.alias("_right")).withColumn("_parts", F.transform(F.split("_right", ","), lambda p: strip(p)))
    staged = staged.withColumn("_last", F.lower(F.element_at("_parts", -1)))
    joined = staged.join(valid, "_last", "left").join(completions(dictionary).withColumnRenamed("partial", "_last"), "_last", "left")
    head = F.slice("_parts", F.lit(1), F.size("_parts") - 1)
    empty = F.coalesce("tags", F.lit("")) == ""
    action = (
        F.when(empty, "ok").when(F.col("_right").endswith(","), "strip_comma").when(F.col("_valid"), "ok").when(F.col("completion").isNotNull(), "completed")
        .when(F.length("_last") >= SHORTEST_KEPT, "ok").otherwise("removed")
    )
    acted = joined.withColumn("action", action)
    fixed = (
        F.when(F.col("action") == "strip_comma", F.regexp_replace(F.regexp_replace("_right", ",+$", ""), r"(?U)\s+$", ""))
        .when(F.col("action") == "completed", F.array_join(F.concat(head, F.array("completion")), ", "))
        .when(F.col("action") == "removed", F.array_join(head, ", ")).otherwise(F.col("tags"))
    )
    return acted.select("id", "tags", fixed.alias("fixed"), "action")
