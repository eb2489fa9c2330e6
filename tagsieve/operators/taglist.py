"""Algebra of ordered tag lists. Lists are arrays; ``lookup`` frames have tag (compare form) and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import col, comma_tags, compare_form, or_default, strip

_COUNT_TAG = r"(?i)^[1-6]\+?(girl|boy)s?$"


def unique(tags: Column | str) -> Column:
    """First of every group of tags that are equal in compare form, order kept; empty forms are dropped."""
    # The list and its forms are bound once by a transform over one pair; each form then takes its first tag.
    pair = F.array(F.struct(col(tags).alias("t"), F.transform(col(tags), lambda t: compare_form(t)).alias("k")))
    firsts = F.transform(pair, lambda x: F.transform(F.filter(F.array_distinct(x["k"]), lambda k: k != ""), lambda k: F.element_at(x["t"], F.array_position(x["k"], k).cast("int"))))
    return F.get(firsts, 0)


def append_unique(existing: Column | str, incoming: Column | str) -> Column:
    """Existing tags as they stand, then incoming ones whose compare form is new; repeats inside ``existing`` stay."""
    have = F.transform(col(existing), lambda t: compare_form(t))
    fresh = unique(F.filter(col(incoming), lambda t: ~F.array_contains(have, compare_form(t))))
    return F.concat(col(existing), fresh)


def append_raw(current: Column | str, tags: Column | str) -> Column:
    """Texts joined by a comma; an empty side adds none."""
    return F.concat_ws(", ", F.nullif(strip(F.coalesce(col(current), F.lit(""))), F.lit("")), F.nullif(col(tags), F.lit("")))


def prompt_base(tags: Column | str, tag: Column | str) -> Column:
    """The tags, else the canonical tag, else the empty text; stripped."""
    return strip(or_default(tags, or_default(tag, F.lit(""))))


def move_to_front(item: Column | str, history: Column | str, most: int) -> Column:
    """Item first, equal ones removed, cut to ``most``."""
    return F.slice(F.concat(F.array(col(item)), F.array_remove(col(history), col(item))), 1, most)


def in_class_order(rows: DataFrame, id_col: str, tags_col: str, lookup: DataFrame) -> DataFrame:
    """(id, ordered): tags of each row as boys, girls, characters, series, others; stable inside each class.

    The list of a record is short, so it is gathered by its record; the dictionary is joined on the compare form.
    """
    each = rows.select(F.col(id_col), F.posexplode(comma_tags(tags_col)).alias("pos", "tag")).withColumn("_key", compare_form("tag"))
    known = lookup.groupBy(compare_form("tag").alias("_key")).agg(F.max("category").alias("category"))
    joined = each.join(known, "_key", "left")
    rank = class_rank(F.col("tag"), F.col("category"))
    grouped = joined.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(rank.alias("class"), F.col("pos"), F.col("tag")))).alias("x"))
    return grouped.select(id_col, F.array_join(F.transform("x", lambda t: t["tag"]), ", ").alias("ordered"))


def class_rank(tag: Column, category: Column) -> Column:
    """Boys, girls, characters, series, others."""
    count_tag = tag.rlike(_COUNT_TAG)
    return F.when(count_tag & F.lower(tag).contains("boy"), 0).when(count_tag, 1).when(category == 4, 2).when(category == 3, 3).otherwise(4)


def ordered_by(tags: Column | str, categories: Column) -> Column:
    """The list in class order, stable inside each class; ``categories`` is a map from compare form to category."""
    placed = F.transform(col(tags), lambda t, k: F.struct(class_rank(t, F.try_element_at(categories, compare_form(t))).alias("class"), k.alias("pos"), t.alias("tag")))
    return F.transform(F.array_sort(placed), lambda x: x["tag"])


def with_head(tags: Column | str, head: Column | str) -> Column:
    """``head`` in front unless a tag equals it in compare form."""
    forms = F.transform(col(tags), lambda t: compare_form(t))
    return F.when(F.array_contains(forms, compare_form(head)) | (compare_form(head) == ""), col(tags)).otherwise(F.array_prepend(col(tags), col(head)))
