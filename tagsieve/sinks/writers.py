"""Writers: JSON state per user, exported tag files, appended and rewritten catalogs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import file_name, strip


def favorites_json(favorites: DataFrame) -> DataFrame:
    """(user_id, value): the ids of each user as a sorted JSON array."""
    return favorites.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list("char_id"))).alias("value"))


def ordered_json(lists: DataFrame) -> DataFrame:
    """(user_id, value): items (user_id, place, item) of each user as a JSON array in order; lists are capped by their makers."""
    grouped = lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("x"))
    return grouped.select("user_id", F.to_json(F.transform("x", lambda r: r["item"])).alias("value"))


def recents_json(recents: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, value): each user's list (user_id, place, item) as a JSON array of records of the catalog, in order; absent
    texts are empty. Lists are capped by their makers; items without a record have the empty texts too."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("name", "series", "tags", "danbooru_tag", "image_url")]
    rows = recents.join(catalog.select(F.col("id").alias("item"), "name", "series", "tags", "danbooru_tag", "image_url", "source"), "item", "left")
    record = F.struct("place", F.struct(F.col("item").alias("id"), *texts, F.coalesce("source", F.lit("danbooru")).alias("source")).alias("record"))
    grouped = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(record)).alias("x"))
    return grouped.select("user_id", F.to_json(F.transform("x", lambda r: r["record"])).alias("value"))


def wildcard_files(rows: DataFrame) -> DataFrame:
    """(wildcard, value): the files of an export, one for each name made fit for files; blank names and tags are left out,
    of several entries of one name the last by its tags stays."""
    kept = rows.select(file_name("name").alias("wildcard"), strip("tags").alias("value")).where((F.col("wildcard") != "") & (F.col("value") != ""))
    return kept.groupBy("wildcard").agg(F.max("value").alias("value"))


def write_wildcards(rows: DataFrame, path: str) -> None:
    """``<name>.txt`` in the folder (any URI that Arrow can open) for each of wildcard_files, written by the executors; other
    files of the folder stay."""

    def save(part: Iterator) -> None:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        for row in part:
            with store.open_output_stream(f"{folder}/{row['wildcard']}.txt") as out:
                out.write((row["value"] + "\n").encode())

    wildcard_files(rows).foreachPartition(save)


def append_catalog(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_catalog(rows: DataFrame, path: str) -> None:
    """Rewrite the catalog partitioned by source and sorted by rank, so that facets prune files."""
    rows.repartition("source").sortWithinPartitions("rank", "id").write.partitionBy("source").mode("overwrite").parquet(path)
