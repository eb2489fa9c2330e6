"""Items that appear together: exact pair counts against a bipartite configuration null.

Counting. A pair can only reach ``min_rows`` common records if both items do, so items below it are dropped before pairs
are made (exact), and so are items above ``max_rows`` where the caller's lift bound excludes them. At most
(mean basket size) * rows / min_rows items can be left: with min_rows a fixed share of the rows the list does not grow
with the data, which is the bound under which it is sent to the executors. Pairs are counted inside each task before
anything is shuffled: items become integers, each batch of baskets gives pair codes in bulk, and only
(code, count) totals leave the task.

Null model. Item i stands in basket r with probability x_i*y_r / (1 + x_i*y_r), where x and y are fitted so that the
expected item frequencies and basket sizes equal the observed ones. Items with the same frequency share x and baskets
of the same size share y, so the fit works on two histograms, which are taken as they are: no classes are merged. A
pair's count is then a sum of independent draws over baskets (Poisson-binomial, with equal probabilities inside a size
class); its upper tail is taken by the saddle point with continuity correction. Benjamini-Hochberg values come from a
histogram of the logarithms of the tails with the upper edge of each bin, so that they are never too small. Every pair
of the items that are left counts as a test, those below ``min_rows`` with a tail of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.session import written

#: Items sent to the executors; with a least count of one basket in c and s items a basket there are at most c * s.
MOST_ITEMS = 5_000_000
#: Pair codes held in a task before they are merged.
CODES = 4_000_000
#: Width of the bins of log10 tails.
BIN = 0.01
#: Cells of a table of probabilities that is held at once; more classes mean more blocks.
CELLS = 1_000_000


def _pair_codes(flat: np.ndarray, offsets: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """Codes a * m + b, a < b, of all pairs inside each basket of sorted distinct integers, in bounded arrays."""
    sizes = np.diff(offsets)
    for size in np.unique(sizes[sizes >= 2]):
        starts = offsets[:-1][sizes == size]
        if size > 2000:  # one basket at a time, one item against the later ones
            for start in starts:
                items = flat[start : start + size]
                for k in range(size - 1):
                    yield items[k] * m + items[k + 1 :]
            continue
        left, right = np.triu_indices(int(size), 1)
        step = max(1, CODES // len(left))
        for at in range(0, len(starts), step):
            table = flat[starts[at : at + step, None] + np.arange(size)]
            yield (table[:, left] * m + table[:, right]).ravel()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def _count_pairs(shared):
    """mapInArrow function: baskets (list<string> of distinct items) to (code, n) totals of the task; ``shared`` broadcasts the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, m = pa.array(shared.value, pa.string()), len(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def batch_of(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        for batch in batches:
            lists = batch.column("items")
            index = pc.index_in(lists.flatten().cast(pa.string()), value_set=wanted)
            rows = pc.list_parent_indices(lists).to_numpy()
            kept = index.is_valid().to_numpy(zero_copy_only=False)
            flat, rows = index.fill_null(0).to_numpy()[kept].astype(np.int64), rows[kept]
            order = np.lexsort((flat, rows))
            flat, rows = flat[order], rows[order]
            offsets = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows)) if len(rows) else np.zeros(1, int)
            for codes in _pair_codes(flat, offsets, m):
                unique, counts = np.unique(codes, return_counts=True)
                held.append((unique, counts.astype(np.int64)))
                size += len(unique)
                if size > CODES:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > CODES // 2:  # the totals themselves are many: hand them on
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*_merge(held))

    return run


def item_counts(baskets: DataFrame) -> DataFrame:
    """(item, n_item) of baskets (items array<string>, distinct within the basket)."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))


def pair_counts(baskets: DataFrame, min_rows: int, max_rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab) of all pairs that stand together in at least ``min_rows`` baskets, item_a < item_b.

    ``baskets`` has a column items, array<string>, of distinct values; NULL or empty arrays hold no pair. Items in fewer
    than ``min_rows`` or more than ``max_rows`` baskets are left out. Repeated baskets count each time.
    """
    spark = baskets.sparkSession
    counts = item_counts(baskets) if counts is None else counts
    kept = counts.where((F.col("n_item") >= min_rows) & F.col("item").isNotNull())
    if max_rows is not None:
        kept = kept.where(F.col("n_item") <= max_rows)
    # UTF-8 order equals code point order, and the codes follow it.
    listed = kept.limit(MOST_ITEMS + 1).collect()
    if len(listed) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items stand in {min_rows} baskets; take a larger share of the baskets as least count")
    rows = sorted(listed, key=lambda r: r["item"].encode("utf-8", "surrogatepass"))
    items, m = [r["item"] for r in rows], max(1, len(rows))
    coded = baskets.select("items").mapInArrow(_count_pairs(spark.sparkContext.broadcast(items)), "code long, n long")
    totals = coded.groupBy("code").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_rows)
    totals = totals.select(F.expr(f"code div {m}").alias("a"), F.expr(f"code % {m}").alias("b"), "n_ab")
    names = spark.createDataFrame(pd.DataFrame({"k": range(len(rows)), "item": items, "n_item": [r["n_item"] for r in rows]}), "k long, item string, n_item long")
    a = names.select(F.col("k").alias("a"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = names.select(F.col("k").alias("b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    return totals.join(a, "a").join(b, "b").select("item_a", "item_b", "n_a", "n_b", "n_ab")


def _margin(of: np.ndarray, others: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weights * others / (1 + of_i * others) for each of ``of``, in blocks of CELLS cells."""
    step = max(1, CELLS // max(1, len(others)))
    parts = [(weights * others / (1 + np.outer(of[at : at + step], others))).sum(1) for at in range(0, len(of), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Fitness x of each item frequency and y of each basket size (``items`` and ``baskets`` are the class counts)."""
    degrees, sizes = np.asarray(degrees, float), np.asarray(sizes, float)
    edges = max(1.0, float((degrees * items).sum()))
    x, y = degrees / np.sqrt(edges), sizes / np.sqrt(edges)
    for _ in range(rounds):
        old = x
        x = degrees / np.maximum(_margin(x, y, baskets), 1e-300)
        x = np.minimum(x, 1e12)
        y = sizes / np.maximum(_margin(y, x, items), 1e-300)
        y = np.minimum(y, 1e12)
        if np.max(np.abs(x - old) / np.maximum(x, 1e-300), initial=0) < 1e-9:
            break
    return x, y


def log_tail(n_ab: np.ndarray, p: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts and log10 of P(count >= n_ab); ``p`` has a row for each pair and a column for each class of m baskets."""
    from math import erfc

    mean = p @ m
    k = n_ab - 0.5
    t = np.log(np.maximum(k, 0.25) / np.maximum(mean, 1e-300)).clip(-50, 50)
    top = m.sum()
    for _ in range(60):
        e = np.exp(t)[:, None]
        q = p * e / (1 - p + p * e)
        step = (q @ m - k) / np.maximum((q * (1 - q)) @ m, 1e-12)
        t = np.clip(t - np.clip(step, -1, 1), -50, 50)
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    e = np.exp(t)[:, None]
    q = p * e / (1 - p + p * e)
    spread = np.sqrt(np.maximum((q * (1 - q)) @ m, 1e-12))
    rate = np.log1p(p * (e - 1)) @ m - t * k
    w = np.sign(t) * np.sqrt(np.maximum(-2 * rate, 0))
    u = 2 * np.sinh(t / 2) * spread
    with np.errstate(all="ignore"):
        density = np.exp(-w * w / 2) / np.sqrt(2 * np.pi)
        tail = np.array([erfc(v / np.sqrt(2)) / 2 for v in w]) + density * (1 / u - 1 / w)
        far = (-w * w / 2 - np.log(np.maximum(u * np.sqrt(2 * np.pi), 1e-300))) / np.log(10)
        out = np.where((w > 5) & (tail < 1e-6), far, np.log10(np.clip(tail, 1e-300, 1)))
    out = np.where((np.abs(t) < 1e-4) | ~np.isfinite(out), np.log10(0.5), out)
    return mean, np.where(n_ab > top, -np.inf, np.minimum(out, 0))


def pair_surprise(baskets: DataFrame, min_rows: int, max_rows: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """pair_counts with ``expected`` under the null, ``log10_p`` of the upper tail and ``q``, the false-discovery value.

    Item frequencies and basket sizes of all items and baskets enter the null, also of those left out as pairs. The
    number of tests is that of all pairs of items which ``min_rows`` and ``max_rows`` admit, listed or not.
    """
    counts = item_counts(baskets) if counts is None else counts
    pairs = written(pair_counts(baskets, min_rows, max_rows, counts))
    by_degree = counts.groupBy("n_item").agg(F.count(F.lit(1)).alias("n"), F.count("item").alias("named")).toPandas()
    by_size = baskets.select(F.greatest(F.size("items"), F.lit(0)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("size > 0").toPandas()
    degrees, items = by_degree.sort_values("n_item")[["n_item", "n"]].to_numpy(float).T
    sizes, rows = by_size.sort_values("size")[["size", "n"]].to_numpy(float).T
    x, y = fit_null(degrees, items, sizes, rows)
    admitted = (by_degree["n_item"] >= min_rows) & (max_rows is None or by_degree["n_item"] <= max_rows)
    k = int(by_degree["named"][admitted].sum())
    step = min(4000, max(1, CELLS // max(1, len(rows))))

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at : at + step]
                a, b = (x[np.searchsorted(degrees, part[c].to_numpy(float))][:, None] * y for c in ("n_a", "n_b"))
                mean, tail = log_tail(part["n_ab"].to_numpy(float), (a / (1 + a)) * (b / (1 + b)), rows)
                yield part.assign(expected=mean, log10_p=np.maximum(tail, -1e6))

    schema = "item_a string, item_b string, n_a long, n_b long, n_ab long, expected double, log10_p double"
    tested = written(pairs.mapInPandas(tails, schema)).withColumn("bin", F.greatest(F.ceil(F.col("log10_p") / BIN), F.lit(-40_000)))
    bins = tested.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")  # at most 40,001 rows
    upper = np.power(10.0, bins["bin"].to_numpy(float) * BIN)
    q = np.minimum.accumulate((upper * (k * (k - 1) // 2) / np.maximum(bins["n"].cumsum().to_numpy(float), 1))[::-1])[::-1]
    values = baskets.sparkSession.createDataFrame(pd.DataFrame({"bin": bins["bin"].astype("int64"), "q": np.minimum(q, 1.0)}), "bin long, q double")
    return tested.join(values, "bin").drop("bin")
