"""Keyed user state in batch form: recent lists, toggles, overrides, caches. Logs have action_id, user_id, ts, act, char_id, typed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_CAP, RECENT_CAP, TTL_SECONDS, CACHE_CAP = 20, 100, 1800, 500


def once(log: DataFrame) -> DataFrame:
    """Redelivered rows have the same action_id; one stays, the one received first."""
    order = F.struct("received_at", "ts", "user_id", "act", "char_id", "typed")
    return log.groupBy("action_id").agg(F.min_by(F.struct("user_id", "ts", "act", "char_id", "typed"), order).alias("r")).select("action_id", "r.*")


def most_recent(log: DataFrame, item: Column, cap: int) -> DataFrame:
    """(user_id, place, item): distinct items of each user, latest use first, at most ``cap``.

    Uses are reduced to one row an item before they are ordered; ties of time go by action_id.
    """
    latest = log.select("user_id", item.alias("item"), F.struct("ts", "action_id").alias("at")).groupBy("user_id", "item").agg(F.max("at").alias("at"))
    ranked = latest.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))).where(F.col("place") <= cap)
    return ranked.select("user_id", "place", "item")


def search_history(log: DataFrame) -> DataFrame:
    """Last 20 distinct searches of each user; blank ones are ignored."""
    searches = once(log).where((F.col("act") == "search") & F.col("typed").rlike(r"(?U)\S"))
    return most_recent(searches, F.regexp_replace("typed", r"(?U)^\s+|\s+$", ""), HISTORY_CAP)


def recently_viewed(log: DataFrame) -> DataFrame:
    """Last 100 distinct rows of the catalog that each user viewed."""
    return most_recent(once(log).where((F.col("act") == "view") & F.col("char_id").isNotNull()), F.col("char_id"), RECENT_CAP)


def recent_pages(recents: DataFrame, number: int, size: int = 30) -> DataFrame:
    """Page ``number`` of each user's list (user_id, place, item), the nearest one where the user has fewer pages."""
    pages = recents.groupBy("user_id").agg(F.expr(f"(max(place) + {size - 1}) div {size}").cast("int").alias("pages"))
    shown = recents.join(pages, "user_id").withColumn("page", F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages"))))
    return shown.where(F.expr(f"(place - 1) div {size} = page - 1")).select("user_id", "page", "place", "item")


def cleared(state: DataFrame, users: DataFrame) -> DataFrame:
    """The state without the users (user_id) who cleared it."""
    return state.join(users.select("user_id").distinct(), "user_id", "left_anti")


def first_of(ids: DataFrame, *lists: DataFrame) -> DataFrame:
    """(id, place, row): for each id (column id) the row of the first of the lists, all with equal columns, that has it."""
    marked = [rows.select("id", F.lit(k).alias("place"), F.struct(*rows.columns).alias("row")) for k, rows in enumerate(lists)]
    every = reduce(DataFrame.unionByName, marked).join(ids.select("id").distinct(), "id", "left_semi")
    return every.groupBy("id").agg(F.min(F.struct("place", "row")).alias("x")).select("id", "x.place", "x.row")


def favorites(log: DataFrame) -> DataFrame:
    """(user_id, char_id) toggled an odd number of times."""
    toggles = once(log).where((F.col("act") == "favorite") & F.col("char_id").isNotNull())
    return toggles.groupBy("user_id", "char_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1).select("user_id", "char_id")


def overrides(log: DataFrame) -> DataFrame:
    """(id, danbooru_tag): the latest manual tag of each row of the catalog."""
    given = once(log).where((F.col("act") == "override") & F.col("char_id").isNotNull())
    return given.groupBy(F.col("char_id").alias("id")).agg(F.max_by("typed", F.struct("ts", "action_id")).alias("danbooru_tag"))


def cache_use(fetches: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, at, hit): whether an answer younger than ``ttl`` seconds was at hand. An answer lives from its last fetch, so the
    state is a fold over the requests of a key in order of time.

    The fold needs one number from request to request; rows stream through in batches, sorted by key and time in partitions
    cut by key, and nothing but the last fetch of the current key is held. Only fetches are stepped through: what an answer
    serves is found by binary search.
    """
    ready = fetches.select(F.col(key).alias("key"), F.col(at).alias("at")).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    ordered = ready.repartition("key").sortWithinPartitions("key", "at")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fetched = None, None
        for f in frames:
            if not len(f):
                continue
            times, keys = f["at"].to_numpy("datetime64[us]").astype("int64"), f["key"].to_numpy()
            hits = np.ones(len(f), dtype=bool)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(f))):
                if keys[a] != current:
                    current, fetched = keys[a], None
                at = a if fetched is None else a + int(np.searchsorted(times[a:b], fetched + ttl * 1_000_000))
                while at < b:
                    hits[at], fetched = False, int(times[at])
                    at = a + int(np.searchsorted(times[a:b], fetched + ttl * 1_000_000))
            yield f.assign(hit=hits)

    kind = dict(ready.dtypes)
    return ordered.mapInPandas(fold, f"key {kind['key']}, at {kind['at']}, hit boolean")


def cached_items(log: DataFrame, cap: int = CACHE_CAP) -> DataFrame:
    """(item): what a least-recently-used cache of ``cap`` entries holds after all accesses of char_id."""
    latest = log.where(F.col("char_id").isNotNull()).groupBy(F.col("char_id").alias("item")).agg(F.max(F.struct("ts", "action_id")).alias("at"))
    return latest.orderBy(F.desc("at")).limit(cap).select("item")
