"""The tag dictionary: loading, searching, lookups by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import comma_tags, display_form, glob_regex, strip

#: Names of the category codes. Fixed values.
CATEGORY_NAMES = {0: "general", 1: "artist", 3: "copyright", 4: "character", 5: "meta"}


def category_name(c: Column | str, default: str = "unknown") -> Column:
    pairs = [x for k, v in CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c), F.lit(default))


def normalised(raw: DataFrame) -> DataFrame:
    """Rows of a dictionary file: if either number cannot be read both are 0, aliases are a comma list, blank tags go."""
    kept = raw.select("line_no", strip("tag").alias("tag"), F.col("category").cast("int").alias("c"), F.col("post_count").cast("long").alias("p"), "aliases").where(F.col("tag") != "")
    broken = F.col("c").isNull() | F.col("p").isNull()
    return kept.select(
        "line_no", "tag",
        F.when(broken, F.lit(0)).otherwise(F.col("c")).alias("category"),
        F.when(broken, F.lit(0).cast("long")).otherwise(F.col("p")).alias("post_count"),
        comma_tags("aliases").alias("aliases"),
    )


def load(raw: DataFrame) -> DataFrame:
    """One row a tag: its first place in the file with the values of its last line."""
    rows = normalised(raw)
    last = F.max_by(F.struct("category", "post_count", "aliases"), "line_no").alias("v")
    return rows.groupBy("tag").agg(F.min("line_no").alias("line_no"), last).select("line_no", "tag", "v.*").withColumn("category_name", category_name("category"))


def upsert(dictionary: DataFrame, records: DataFrame) -> DataFrame:
    """Add API records (name, category, post_count); they replace values, keep the place and have no aliases."""
    new = records.groupBy(F.col("name").alias("tag")).agg(F.max_by(F.struct("category", "post_count"), F.col("seq")).alias("r"), F.min("seq").alias("seq"))
    last = dictionary.agg(F.max("line_no")).first()[0] or 0
    joined = dictionary.join(new, "tag", "full_outer")
    return joined.select(
        F.coalesce("line_no", F.lit(last) + F.col("seq") + 1).alias("line_no"), "tag",
        F.coalesce("r.category", "category").alias("category"), F.coalesce("r.post_count", "post_count").alias("post_count"),
        F.when(F.col("r").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("aliases")).alias("aliases"),
    ).withColumn("category_name", category_name("category"))


def search(dictionary: DataFrame, pattern: str, least_posts: int = 500, most: int = 100, categories: tuple[int, ...] = (0, 4)) -> DataFrame:
    """Tags of the categories with enough posts that match the lower-cased shell pattern or contain it; most used first."""
    wanted = pattern.lower()
    hit = F.col("tag").rlike(glob_regex(wanted)) | F.contains("tag", F.lit(wanted))
    found = dictionary.where(F.col("category").isin(*categories) & (F.col("post_count") >= least_posts) & hit)
    return found.orderBy(F.desc("post_count"), "line_no").limit(most).select("line_no", "tag", "category", "category_name", "post_count")


def lookup(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted name (column wanted): the tag itself, else the first tag in file order that lists it as alias."""
    wanted = names.select("wanted").distinct()
    own = dictionary.select(F.col("tag").alias("wanted"), F.lit(0).alias("prio"), "line_no", "tag")
    other = dictionary.select(F.explode("aliases").alias("wanted"), F.lit(1).alias("prio"), "line_no", "tag")
    hits = wanted.join(own.unionByName(other), "wanted")
    return hits.groupBy("wanted").agg(F.min_by("tag", F.struct("prio", "line_no")).alias("tag"), F.min("prio").alias("by_alias"))


def ranked_search(dictionary: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Character tags that contain the query, best first: exact, name with one bracket, prefix, more posts, shorter."""
    q = query.strip().replace(" ", "_").lower()
    tag = F.col("tag")
    once = (F.length(tag) - F.length(F.replace(tag, F.lit("_("), F.lit("")))) == 2
    score = F.struct(
        (tag == q).cast("int").alias("exact"), (tag.startswith(f"{q}_(") & once).cast("int").alias("bracket"), tag.startswith(f"{q}_").cast("int").alias("prefix"),
        tag.contains(q).cast("int").alias("inside"), F.col("post_count").alias("posts"), (-F.length(tag)).alias("short"),
    )
    found = dictionary.where((F.col("category") == 4) & tag.contains(q) & F.lit(q != ""))
    return found.select("line_no", display_form("tag").alias("tag"), "post_count", score.alias("score")).orderBy(F.desc("score"), "line_no").limit(most).select("line_no", "tag", "post_count", "score.exact", "score.bracket", "score.prefix")


def alias_index(dictionary: DataFrame, category: int = 4) -> DataFrame:
    """(key, canonical) in lower case: a tag's own name wins over aliases, among aliases the first line, among names the last."""
    rows = dictionary.where(F.col("category") == category)
    own = rows.select(F.lower("tag").alias("key"), F.lit(0).alias("prio"), (-F.col("line_no")).alias("place"), F.col("tag").alias("canonical"))
    other = rows.select(F.explode(F.transform("aliases", lambda a: F.lower(a))).alias("key"), F.lit(1).alias("prio"), F.col("line_no").alias("place"), F.col("tag").alias("canonical"))
    return own.unionByName(other).groupBy("key").agg(F.min_by("canonical", F.struct("prio", "place", "canonical")).alias("canonical"))


def redirect(values: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """Replace a value by the first consequent of its name, or leave it."""
    first = redirects.where(F.col("antecedent_name").isNotNull()).groupBy(F.col("antecedent_name").alias(column)).agg(F.min("consequent_name").alias("_to"))
    return values.join(first, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def wiki_links(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, link) of ``[[tag]]`` and ``[[tag|label]]`` in order; blanks become ``_``, lower case."""
    links = F.regexp_extract_all(F.col(text_col), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    rows = texts.select(F.col(id_col), F.posexplode_outer(links).alias("pos", "raw")).where(F.col("raw").isNotNull())
    return rows.select(id_col, "pos", F.lower(F.replace(strip("raw"), F.lit(" "), F.lit("_"))).alias("link"))

