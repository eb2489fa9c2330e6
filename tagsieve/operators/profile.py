"""Tag-frequency profiles over tagged posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsieve.functions.text import display_form
from tagsieve.operators.dictionary import category_name

#: General tags that speak of the picture file, not of its content. Fixed values.
NOISE_TAGS = [
    "highres", "absurdres", "ultra-detailed", "commentary", "commentary request", "english commentary", "translation request", "translated", "paid reward available",
    "patreon reward", "official art", "scan", "censored", "uncensored", "jpeg artifacts", "watermark", "web address", "signature",
]
LEAST_SHARE, MOST_TAGS, MOST_POSTS = 0.08, 40, 200


def latest_posts(posts: DataFrame) -> DataFrame:
    """One row a seed and post: the latest fetch."""
    last = posts.groupBy("seed_tag", "post_id").agg(F.max_by(F.struct("tag_string_general", "tag_string_character", "tag_string_copyright", "tag_string"), "fetched_at").alias("p"))
    return last.select("seed_tag", "post_id", "p.*")


def sampled_posts(posts: DataFrame, most: int = 120) -> DataFrame:
    """The newest posts of each seed, at most ``most`` and never more than MOST_POSTS; a smaller number than 1 gives none.

    The filter on the row number is pushed in front of the exchange, so a hot seed leaves each task as a few rows.
    """
    newest = F.row_number().over(Window.partitionBy("seed_tag").orderBy(F.desc("post_id")))
    return posts.withColumn("_k", newest).where(F.col("_k") <= min(most, MOST_POSTS)).drop("_k")


def _tags(c: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+"), lambda t: t != "")


def post_tags(posts: DataFrame) -> DataFrame:
    """(seed_tag, post_id, category, pos, raw_tag), repeats kept. ``tag_string`` counts as general for a seed none of whose
    posts has tags in the three categories."""
    lists = posts.select("seed_tag", "post_id", F.array(*(F.struct(F.lit(k).alias("category"), _tags(c).alias("tags")) for k, c in ((4, "tag_string_character"), (3, "tag_string_copyright"), (0, "tag_string_general"), (-1, "tag_string")))).alias("all"))
    each = lists.select("seed_tag", "post_id", F.explode("all").alias("x")).select("seed_tag", "post_id", "x.category", F.posexplode("x.tags").alias("pos", "raw_tag"))
    new_style = posts.groupBy("seed_tag").agg(F.max(((F.size(_tags("tag_string_general")) + F.size(_tags("tag_string_character")) + F.size(_tags("tag_string_copyright"))) > 0).cast("int")).alias("new_style"))
    joined = each.join(new_style, "seed_tag")
    kept = joined.where(((F.col("category") >= 0) & (F.col("new_style") == 1)) | ((F.col("category") == -1) & (F.col("new_style") == 0)))
    return kept.withColumn("category", F.greatest("category", F.lit(0))).drop("new_style")


def profiles(posts: DataFrame, least_share: float = LEAST_SHARE, most: int = MOST_TAGS) -> DataFrame:
    """For each seed the frequent tags: characters, then copyrights, then general ones, each by count, then first occurrence.

    A tag is listed once, in its first category. The share is the count over the number of posts of the seed.
    """
    totals = posts.groupBy("seed_tag").agg(F.count(F.lit(1)).alias("posts"))
    counted = post_tags(posts).groupBy("seed_tag", "category", "raw_tag").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("post_id", "pos")).alias("first"))
    shares = counted.join(totals, "seed_tag").withColumn("share", F.col("count") / F.col("posts"))
    noise = (F.col("category") == 0) & display_form("raw_tag").isin(NOISE_TAGS)
    kept = shares.where((F.col("share") >= least_share) & ~noise).withColumn("prio", F.when(F.col("category") == 4, 0).when(F.col("category") == 3, 1).otherwise(2))
    # Shares are bounded below, so a seed has at most (tags a post) / least_share rows here.
    once = kept.withColumn("k", F.row_number().over(Window.partitionBy("seed_tag", "raw_tag").orderBy("prio"))).where("k = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("seed_tag").orderBy("prio", F.desc("count"), "first"))).where(F.col("place") <= most)
    return ranked.select(
        "seed_tag", "place", display_form("raw_tag").alias("tag"), "raw_tag", "count", F.round("share", 3).alias("frequency"), "category", category_name("category", "general").alias("category_name")
    )


def without_present(profile: DataFrame, prompt: str) -> DataFrame:
    """Leave out tags that the prompt already has; the prompt is split at commas and lower-cased, its ``_`` stay."""
    present = [t for t in (p.strip().lower() for p in prompt.split(",")) if t]
    return profile.where(~F.lower("tag").isin(present)) if present else profile


def buckets(profile: DataFrame) -> DataFrame:
    """Tags of each seed by category, unknown codes as general, in profile order."""
    code = F.when(F.col("category").isin(0, 1, 3, 4, 5), F.col("category")).otherwise(0)
    grouped = profile.groupBy("seed_tag", code.alias("category")).agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("x"))
    return grouped.select("seed_tag", "category", F.transform("x", lambda t: t["tag"]).alias("tags"))
