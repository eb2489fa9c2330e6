"""The keyed state of operators.state as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagsieve.operators.state import HISTORY_CAP, TTL_SECONDS
from tagsieve.session import shared_folder

LOG = "action_id long, user_id long, ts timestamp, received_at timestamp, act string, char_id long, typed string"
#: Bytes of Parquet in a batch where a log that is there is read to its end.
BATCH_BYTES = 256 * 1024 * 1024


def read_log(spark: SparkSession, pattern: str, files_a_batch: int = 1, bytes_a_batch: int | None = None) -> DataFrame:
    """The log as a stream of Parquet files that match a path pattern, so many files a batch or, where it is given, files of about so many bytes.

    Every batch opens and commits all state, which takes longer than the rows of a small file; a log of many files is read by bytes.
    """
    limit = ("maxBytesPerTrigger", bytes_a_batch) if bytes_a_batch else ("maxFilesPerTrigger", files_a_batch)
    return spark.readStream.schema(LOG).option(*limit).parquet(pattern)


def deduplicated(log: DataFrame, delay: str | None = None) -> DataFrame:
    """Redelivered rows leave once; with a delay, state older than it is dropped."""
    return log.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["action_id"]) if delay else log.dropDuplicates(["action_id"])


def by_receipt(log: DataFrame) -> DataFrame:
    """The rows of every batch as received, so that of redelivered rows that differ ``deduplicated`` keeps the first one.

    Spark's check refuses any sort in a stream, though one inside partitions holds no rows back: ``run_to_end`` needs ``checked=False``.
    """
    return log.repartition("action_id").sortWithinPartitions("received_at", "ts", "user_id", "act", "char_id", "typed")


def favorite_counts(log: DataFrame) -> DataFrame:
    """Toggles of every (user, row); odd counts are favorites."""
    toggles = deduplicated(log).where((F.col("act") == "favorite") & F.col("char_id").isNotNull())
    return toggles.groupBy("user_id", "char_id").agg(F.count(F.lit(1)).alias("n"))


def search_histories(log: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """(user_id, place, item): the list of a user after every batch that touched it; state is the capped list."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        latest = {item: (ts, action) for item, ts, action in held}
        for f in frames:
            for item, micros, action in zip(f["item"].tolist(), f["at"].tolist(), f["action_id"].tolist()):
                at = (micros, int(action))
                if item not in latest or latest[item] < at:
                    latest[item] = at
            if len(latest) > 50 * cap:
                latest = dict(sorted(latest.items(), key=lambda x: x[1], reverse=True)[:cap])
        kept = sorted(latest.items(), key=lambda x: x[1], reverse=True)[:cap]
        state.update(([k for k, _ in kept], [a for _, (a, _) in kept], [b for _, (_, b) in kept]))
        yield pd.DataFrame({"user_id": key[0], "place": range(1, len(kept) + 1), "item": [k for k, _ in kept]})

    # microseconds, as pandas takes long to make timestamps for each user
    searches = log.where((F.col("act") == "search") & F.col("typed").rlike(r"(?U)\S")).select("user_id", F.coalesce(F.unix_micros("ts"), F.lit(-(2**63))).alias("at"), "action_id", F.regexp_replace("typed", r"(?U)^\s+|\s+$", "").alias("item"))
    return searches.groupBy("user_id").applyInPandasWithState(update, "user_id long, place int, item string", "items array<string>, at array<long>, action array<long>", "update", GroupStateTimeout.NoTimeout)


def late_aware_counts(log: DataFrame, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """Actions by day and kind; rows later than the delay are left out."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "act").agg(F.count(F.lit(1)).alias("n"))


def post_cache(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, at, hit) of requests (key, at) with an answer kept ``ttl`` seconds from its fetch; state is the fetch time."""

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values("at")
            hits = []
            for t in f["at"]:
                now = t.value // 1000
                hit = fetched is not None and now - fetched < ttl * 1_000_000
                fetched = fetched if hit else now
                hits.append(hit)
            yield f.assign(hit=hits)[["key", "at", "hit"]]
        if fetched is not None:
            state.update((fetched,))

    return requests.groupBy("key").applyInPandasWithState(update, "key string, at timestamp, hit boolean", "fetched long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checked: bool = True) -> DataFrame:
    """Process what is there and return the final table, written in the shared folder batch by batch; ``checked``: by Spark for operations that it doesn't support."""
    spark = stream.sparkSession
    import uuid

    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    check = "spark.sql.streaming.unsupportedOperationCheck"
    before = spark.conf.get(check, "true")
    spark.conf.set(check, before if checked else "false")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(check, before)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out/number=*")
