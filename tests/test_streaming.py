"""Streaming state gives what the batch form gives."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from tagsieve.operators import state as batch
from tagsieve.plans import queries
from tagsieve.session import shared_folder
from tagsieve.streaming import state as stream


def write_log(spark, folder, parts):
    start = dt.datetime(2024, 1, 1)
    for k, part in enumerate(parts):
        rows = [(a, u, start + dt.timedelta(minutes=a), start + dt.timedelta(minutes=a), act, c, t) for a, u, act, c, t in part]
        spark.createDataFrame(rows, stream.LOG).coalesce(1).write.parquet(f"{folder}/part{k}")


def test_state_over_batches(spark, tmp_path):
    parts = [
        [(1, 1, "search", None, "a"), (2, 1, "search", None, "b"), (3, 1, "favorite", 5, None), (4, 2, "search", None, "z")],
        [(3, 1, "favorite", 5, None), (5, 1, "search", None, "a"), (6, 1, "favorite", 6, None), (7, 1, "favorite", 6, None)],
        [*[(10 + i, 2, "search", None, f"q{i}") for i in range(30)], (50, 1, "search", None, " ")],
    ]
    write_log(spark, str(tmp_path), parts)
    log = spark.read.schema(stream.LOG).parquet(f"{tmp_path}/part*")
    out = stream.run_to_end(stream.favorite_counts(stream.read_log(spark, f"{tmp_path}/part*")), "favorites", "update")
    last = out.groupBy("user_id", "char_id").agg(F.max_by("n", "batch").alias("n")).where("n % 2 = 1")
    assert sorted((r[0], r[1]) for r in last.collect()) == sorted(tuple(r) for r in batch.favorites(log).collect()) == [(1, 5)]
    out = stream.run_to_end(stream.search_histories(stream.deduplicated(stream.read_log(spark, f"{tmp_path}/part*"))), "history", "update")
    final = out.join(out.groupBy("user_id").agg(F.max("batch").alias("batch")), ["user_id", "batch"])
    got = sorted((r["user_id"], r["place"], r["item"]) for r in final.collect())
    assert got == sorted((r["user_id"], r["place"], r["item"]) for r in batch.search_history(log).collect())


def test_windows_and_cache(spark, tmp_path):
    write_log(spark, str(tmp_path), [[(1, 1, "view", 5, None), (2, 1, "view", 5, None), (40, 1, "view", 5, None)]])
    log = stream.read_log(spark, f"{tmp_path}/part*")
    counts = stream.run_to_end(stream.late_aware_counts(log), "counts", "update")
    assert [(r["act"], r["n"]) for r in counts.collect()] == [("view", 3)]
    requests = log.select(F.col("char_id").cast("string").alias("key"), F.col("ts").alias("at"))
    hits = stream.run_to_end(stream.post_cache(requests), "cache", "append")
    assert [r["hit"] for r in hits.orderBy("at").collect()] == [False, True, False]


def batches_of(spark, name, run):
    """What run() gives, and the number of batches of the stream of that name."""
    at = f"{shared_folder(spark).removeprefix('file:')}/{name}-*/out/number=*"
    before = set(glob.glob(at))
    return run(), len(set(glob.glob(at)) - before)


def many_small_files(spark, tmp_path):
    """Each file repeats the last row of the one before it."""
    rows = [(a, a % 3, ("favorite", "search")[a // 3 % 2], a % 4, f"q{a % 30}") for a in range(114)]
    write_log(spark, f"{tmp_path}/actions.parquet", [rows[max(0, k - 1) : k + 10] for k in range(0, 120, 10)])
    for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/actions.parquet/part*/*.parquet"))):
        (tmp_path / "log" / "actions.parquet").mkdir(parents=True, exist_ok=True)
        (tmp_path / "log" / "actions.parquet" / f"part-{k}.parquet").write_bytes(open(f, "rb").read())
    return str(tmp_path / "log")


def test_favorites_of_many_small_files(spark, tmp_path):
    folder = many_small_files(spark, tmp_path)
    wanted = sorted(tuple(r) for r in batch.favorites(spark.read.parquet(f"{folder}/actions.parquet")).collect())
    df, number = batches_of(spark, "favorites", lambda: queries.stream_favorites(spark, folder))
    assert sorted(tuple(r) for r in df.collect()) == wanted and wanted
    assert number == 1
    log = stream.read_log(spark, f"{folder}/actions.parquet*", bytes_a_batch=1)
    out, number = batches_of(spark, "limited", lambda: stream.run_to_end(stream.favorite_counts(log), "limited", "update"))
    last = out.groupBy("user_id", "char_id").agg(F.max_by("n", "batch").alias("n")).where("n % 2 = 1")
    assert sorted((r[0], r[1]) for r in last.collect()) == wanted
    assert number == 12


def test_history_of_many_small_files(spark, tmp_path):
    folder = many_small_files(spark, tmp_path)
    wanted = sorted(tuple(r) for r in batch.search_history(spark.read.parquet(f"{folder}/actions.parquet")).collect())
    df, number = batches_of(spark, "history", lambda: queries.stream_history(spark, folder))
    assert sorted((r["user_id"], r["place"], r["item"]) for r in df.collect()) == wanted and wanted
    assert number == 1
    log = stream.deduplicated(stream.read_log(spark, f"{folder}/actions.parquet*", bytes_a_batch=1))
    out, number = batches_of(spark, "limited", lambda: stream.run_to_end(stream.search_histories(log), "limited", "update"))
    final = out.join(out.groupBy("user_id").agg(F.max("batch").alias("batch")), ["user_id", "batch"])
    assert sorted((r["user_id"], r["place"], r["item"]) for r in final.collect()) == wanted
    assert number == 12


def test_first_received_of_differing_rows(spark, tmp_path):
    """Every action is there twice, in either order and with other content when it came again."""
    start = dt.datetime(2024, 1, 1)
    for k in range(4):
        rows = []
        for a in range(k % 2, 80, 2):
            again = (a // 2 + k // 2) % 2
            rows.append((a, a % 9, start, start + dt.timedelta(days=3 * again, minutes=a), ("favorite", "search")[a // 4 % 2], a + 1000 * again, f"{'ab'[again]}{a}"))
        spark.createDataFrame(rows, stream.LOG).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (tmp_path / "actions.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(tmp_path / "actions.parquet" / f"part-{k}.parquet")
    log = spark.read.parquet(f"{tmp_path}/actions.parquet")
    for form, query in ((batch.favorites, queries.stream_favorites), (batch.search_history, queries.stream_history)):
        wanted, got = form(log), query(spark, str(tmp_path))
        assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
        assert wanted.count() == 40
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck") == "true"
