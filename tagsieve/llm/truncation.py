"""Texts cut off by a field limit or in transfer, found by a model trained on artificial cuts.

Training data need no labels. The values in front of a record's last one are complete, whatever they look like, so a text
that ends after one of them is an intact example with natural rates of misprinted and unlisted endings; the same text
ended inside a value, or right after a separator, is a cut one. Some cuts are made at the lengths at which the source
shows a pile-up, some get a mark of omission.

Features, hashed into a fixed vector of weights: closing characters, closing word, marks at the end, open quotes and
brackets, the text's distance to the next pile-up length of its source, and how often the closing value is seen
complete elsewhere and as the start of longer values. The latter come from the corpus: counts of all values that are
not last in their record (a last value may itself be cut), and of all their prefixes of lengths that closing values have.

The model is a logistic regression fitted on the driver on at most TRAIN_ROWS records; counts, limits and scores cover
every row. The share of cut rows, which artificial examples do not tell, is estimated from the scores by expectation
maximisation over a histogram, and the scores are corrected for it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import blank, plain_form, source_key
from tagsieve.session import written

TRAIN_ROWS = 40_000
WEIGHTS = 1 << 18
#: A length is a limit of a source if so many rows have it and so many times the mean of its ten neighbours.
LIMIT_ROWS, LIMIT_TIMES = 8, 4
BINS = 400
MARKS = ("...", "…", "�")
_SEPARATORS = ",;|、，\t"
#: A value counts as what a fragment may go on to be if it is listed or stands in so many rows: rarer ones are mostly misprints.
LEAST_ROWS = 3
#: Distances to the next pile-up length are told apart up to the last of these.
DISTANCES = (0, 1, 2, 4, 8, 16)


def _bucket(n: float) -> int:
    return 0 if n <= 0 else 1 + int(math.log2(n)) if n < 2**12 else 13


def bare(piece: str) -> tuple[str, str]:
    """A closing piece without a mark of omission behind it, and the mark."""
    for mark in MARKS:
        if len(piece) > len(mark) and piece.endswith(mark):
            return piece[: -len(mark)], mark
    return piece, ""


def near_limit(distance: int) -> int:
    """Class of a distance to the next pile-up length; negative where the source has none above the text."""
    return -1 if distance < 0 else next((k for k, most in enumerate(DISTANCES) if distance <= most), len(DISTANCES))


def next_limit(n: int, limits: list[int]) -> int:
    """Distance from a length to the next of the limits, or -1."""
    return min((m - n for m in limits if m >= n), default=-1)


def plain(value: str) -> str:
    return " ".join(value.lower().replace("_", " ").replace("\\", "").split())


def features(piece: str, tail: str, count: int, source: str, distance: int, support: float, completions: float, listed: bool) -> list[int]:
    """Places in the weights of the features of one text that ends with ``piece`` and ``tail`` behind it, ``distance`` below
    the next pile-up length of its source."""
    near = near_limit(distance)
    stem, mark = (piece, "") if listed else bare(piece)
    words = plain(stem).split(" ")
    lower = stem.lower()
    ended = any(c in tail for c in _SEPARATORS) or "/" in tail
    opened = stem[:1] in "\"'“" and len(stem) > 1 or "(" in stem and ")" not in stem
    s, c = _bucket(support), _bucket(completions)
    ratio = max(-20, min(20, round(2 * math.log2((completions + 0.5) / (support + 0.5)))))
    key = (mark, ended, opened, near, source, s, c, ratio, listed, min(len(words), 6), min(len(words[-1]), 8), count < 4)
    shared = _PLACES.get(key)
    if shared is None:
        if len(_PLACES) > _MEMO:
            _PLACES.clear()
        shared = _PLACES[key] = _hashed(_of_classes(*key))
    first = f"first {words[0]} words {len(words) if len(words) < 3 else 3}"
    return shared + _hashed([f"last {lower[-1:]}", f"last {lower[-2:]}", f"last {lower[-3:]}", f"word {words[-1]}", first])


#: Places of features that depend on few classes alone, kept by the classes.
_PLACES: dict[tuple, list[int]] = {}
_MEMO = 200_000


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % WEIGHTS for n in names]


def _of_classes(mark: str, ended: bool, opened: bool, near: int, source: str, s: int, c: int, ratio: int, listed: bool, n_words: int, length: int, short: bool) -> list[str]:
    at_limit = near == 0
    return [
        "bias",
        f"mark {mark}",
        f"ended {ended}",
        f"ended {ended} seen {s > 0}",
        f"ended {ended} mark {bool(mark)} opened {opened}",
        f"opened {opened}",
        f"limit {near}",
        f"limit {at_limit} seen {s > 1} starts {c > 0}",
        f"limit of {source} {at_limit}",
        f"support {s}",
        f"completions {c}",
        f"ratio {ratio}",
        f"seen {min(s, 5)} starts {min(c, 6)} listed {listed}",
        f"listed {listed} ended {ended}",
        f"words {n_words} seen {s > 0}",
        f"word length {length} seen {s > 0}",
        f"short list {short}",
    ]


def value_counts(lists: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(piece, support, completions, listed): rows with the value not in last place, rows with longer values that start so.

    ``lists`` has vals (array<string>); ``dictionary`` has term, plain forms of listed values. Prefixes are counted for
    the lengths that closing values have, as no other is looked up; a listed value counts once more.
    """
    inner = lists.select(F.explode_outer(F.array_distinct(F.transform(F.slice("vals", F.lit(1), F.greatest(F.size("vals") - 1, F.lit(0))), lambda v: plain_form(v)))).alias("piece"))
    listed = dictionary.select(F.col("term").alias("piece")).where(F.col("piece") != "").distinct()
    both = inner.where(F.col("piece") != "").withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True)))
    counts = written(both.groupBy("piece").agg(F.sum((~F.col("listed")).cast("long")).alias("support"), F.max("listed").alias("listed")))
    closing = F.length(plain_form(F.element_at("vals", -1)))
    ends = lists.select(F.explode(F.array(*(F.greatest(closing - k, F.lit(0)) for k in (0, 1, 3)))).alias("n"))  # without a mark of omission too
    lengths = [r["n"] for r in ends.where("n > 0").distinct().collect()]  # whole numbers, at most the longest closing value
    kept = F.filter(F.from_json(F.lit(str(sorted(lengths))), "array<int>"), lambda n: n < F.length("piece"))
    prefixes = counts.where(F.col("listed") | (F.col("support") >= LEAST_ROWS)).select(F.explode(F.transform(kept, lambda k: F.rtrim(F.substring(F.col("piece"), F.lit(1), k)))).alias("piece"), (F.when(F.col("support") >= LEAST_ROWS, F.col("support")).otherwise(0) + F.col("listed").cast("long")).alias("completions"))
    # Added up by the prefix that the value starts with; both sides meet in one aggregation.
    empty, no = F.lit(0).cast("long"), F.lit(False)
    rows = counts.withColumn("completions", empty).unionByName(prefixes.withColumn("support", empty).withColumn("listed", no))
    return rows.groupBy("piece").agg(F.sum("support").alias("support"), F.sum("completions").alias("completions"), F.max("listed").alias("listed"))


def length_limits(texts: DataFrame) -> DataFrame:
    """(source, n): pile-up lengths of each source, from (source, text)."""
    histogram = texts.groupBy("source", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    near = histogram.select("source", F.explode(F.sequence(F.col("n") - 5, F.col("n") + 5)).alias("n"), "rows").groupBy("source", "n").agg(F.sum("rows").alias("around"))
    found = histogram.where(F.col("rows") >= LIMIT_ROWS).join(near, ["source", "n"]).where(F.col("rows") * 10 >= LIMIT_TIMES * (F.col("around") - F.col("rows")))
    return found.select("source", "n")


def _spans(text: str, values: list[str]) -> list[tuple[int, int]]:
    """Places of the values in the text, one after the other; stops where a value is not found as written."""
    out, at = [], 0
    for v in values:
        start = text.find(v, at)
        if start < 0:
            break
        out.append((start, start + len(v)))
        at = start + len(v)
    return out


def _examples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: records (id, source, text, vals, limits) to artificial examples."""

    for f in frames:
        rows = []
        for id_, source, text, vals, limits in zip(f["id"], f["source"], f["text"], f["vals"], f["limits"]):
            limits = [] if limits is None else [int(m) for m in limits]
            rng = np.random.default_rng(zlib.crc32(repr((id_, source)).encode()))
            spans = _spans(text, list(vals))
            if len(spans) < 3 or len(spans) < len(vals):
                continue
            inner = len(spans) - 1

            def add(cut: int, k: int, piece: str, tail: str, whole: bool, seen: int, mark: str = "") -> None:
                stem = plain(piece)
                rows.append((whole, text[:cut] + mark, piece + mark, tail, k + 1, source, next_limit(len(text[:cut].rstrip()), limits) if not mark else -1, stem, 0 if not whole else seen, 0 if whole else seen))

            k = int(rng.integers(1, inner))
            add(spans[k][1], k, text[slice(*spans[k])], "", True, 1)
            kind = rng.random()
            fitting = [m for m in limits if m < spans[inner - 1][1]]
            if kind < 0.35 and fitting:
                cut = int(rng.choice(fitting))
            else:
                k = int(rng.integers(1, inner))
                a, b = spans[k]
                cut = int(rng.integers(a + 1, b)) if b - a > 1 and kind < 0.85 else spans[k + 1][0] if rng.random() < 0.5 else max(b + 1, len(text[: spans[k + 1][0]].rstrip()))
            k = max(i for i in range(inner) if spans[i][0] < cut or i == 0)
            a, b = spans[k]
            if cut > b:
                tail = text[b:cut]
                if any(c in tail for c in _SEPARATORS + "\n/"):
                    add(cut, k, text[a:b], tail, False, 0)
            elif cut < b:
                fragment = text[a:cut]
                quote = text[a - 1] if a and text[a - 1] in "\"'“" else ""
                mark = MARKS[int(rng.integers(0, 3))] if rng.random() < 0.15 else ""
                if fragment.strip():
                    add(cut, k, quote + fragment.rstrip(), "", False, 1, mark)
        yield pd.DataFrame(rows, columns=["whole", "text", "piece", "tail", "n", "source", "distance", "stem", "own_support", "own_completions"])


def fit(places: list[list[int]], cut: np.ndarray, rounds: int = 300, decay: float = 2e-6) -> np.ndarray:
    """Weights of a logistic regression on binary hashed features, by Adam on all examples."""
    w = np.zeros(WEIGHTS)
    if not len(places):
        return w
    table = np.array(places, dtype=np.int64)
    y = cut.astype(float)
    m, v = np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-w[table].sum(1)))
        gradient = np.bincount(table.ravel(), weights=np.repeat((p - y) / len(y), table.shape[1]), minlength=WEIGHTS) + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return w


def share_of_cut(scores: np.ndarray, rows: np.ndarray) -> float:
    """Share of cut rows by expectation maximisation; ``scores`` are from balanced training."""
    share = 0.1
    for _ in range(200):
        odds = scores / np.maximum(1 - scores, 1e-12) * share / (1 - share)
        new = float((odds / (1 + odds) * rows).sum() / max(1, rows.sum()))
        share = min(0.9, max(1e-5, new))
    return share


def cut_scores(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, source, score) of every record with a non-blank text: the probability that it was cut.

    ``records`` has id, source (NULL allowed), text and vals, the values split from it. NULL and blank texts and texts
    without any value have no score. Repeated rows are scored each. An empty frame gives no rows.
    """
    kept = written(records.where(~blank("text") & (F.size("vals") > 0)).select("id", source_key("source").alias("source"), "text", "vals"))
    counts = written(value_counts(kept, dictionary))
    limits = written(length_limits(kept).groupBy("source").agg(F.sort_array(F.collect_set("n")).alias("limits")))
    rows = kept.count()
    step = max(1, -(-rows // TRAIN_ROWS))
    sample = kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(step)) == 0)  # the bounded sample the model is fitted on
    schema = "whole boolean, text string, piece string, tail string, n int, source string, distance int, stem string, own_support long, own_completions long"
    examples = sample.join(limits, "source", "left").mapInPandas(_examples, schema)
    known = counts.withColumnRenamed("piece", "stem")
    train = examples.join(known, "stem", "left").toPandas().sort_values(["text", "whole"])
    places = [
        features(p, tail, n, s, m, max(0, (0 if pd.isna(a) else a) - oa), max(0, (0 if pd.isna(c) else c) - oc), li is True or li == True)  # noqa: E712
        for p, tail, n, s, m, a, c, li, oa, oc in zip(*(train[x] for x in ("piece", "tail", "n", "source", "distance", "support", "completions", "listed", "own_support", "own_completions")))
    ]
    shared = records.sparkSession.sparkContext.broadcast(fit(places, ~train["whole"].to_numpy(bool)).astype(np.float32))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for f in frames:
            columns = (f[x] for x in ("piece", "tail", "n", "source", "distance", "support", "completions", "listed"))
            places = [features(p, tail, n, s, m, a, c, bool(li)) for p, tail, n, s, m, a, c, li in zip(*columns)]
            out = w[np.array(places, dtype=np.int64)].sum(1) if places else np.zeros(0)
            yield pd.DataFrame({"id": f["id"], "source": f["source"], "raw": 1 / (1 + np.exp(-out))})

    # What the features need of a text is its end: the text itself does not travel through the joins.
    piece = F.element_at("vals", -1)
    behind = F.when(F.contains("text", piece), F.ltrim(F.expr("substring_index(text, element_at(vals, -1), -1)"), F.lit("\"'”"))).otherwise("")
    ends = kept.select("id", "source", F.length(F.rtrim("text")).alias("_length"), piece.alias("piece"), F.size("vals").alias("n"), behind.alias("tail"))
    near = ends.join(limits, "source", "left").withColumn("distance", F.coalesce(F.array_min(F.filter(F.transform("limits", lambda m: m - F.col("_length")), lambda d: d >= 0)), F.lit(-1)))
    looked = near.select("id", "source", "piece", "n", "tail", "distance", plain_form("piece").alias("_exact"), plain_form(F.regexp_replace("piece", r"(?s)(?<=.)(?:\.\.\.|…|\x{fffd})$", "")).alias("_stem"))
    found = F.struct("support", "completions", "listed")
    by_stem = counts.select(F.col("piece").alias("_stem"), found.alias("_c"))
    # A value that ends in a mark of omission by itself is looked up as it stands first.
    plainly = looked.where("_exact = _stem").join(by_stem, "_stem", "left")
    by_exact = counts.where("listed or support > 0").select(F.col("piece").alias("_exact"), found.alias("_a"))
    marked = looked.where("_exact <> _stem").join(by_exact, "_exact", "left").join(by_stem, "_stem", "left").withColumn("_c", F.coalesce("_a", "_c")).drop("_a")
    ready = plainly.unionByName(marked).select(
        "id", "source", "piece", "tail", "n", "distance",
        F.coalesce("_c.support", F.lit(0)).alias("support"), F.coalesce("_c.completions", F.lit(0)).alias("completions"), F.coalesce("_c.listed", F.lit(False)).alias("listed"),
    )
    kind = kept.schema["id"].dataType.simpleString()
    scored = written(ready.mapInPandas(score, f"id {kind}, source string, raw double"))
    histogram = scored.groupBy(F.floor(F.col("raw") * (BINS - 1e-6)).alias("bin")).agg(F.avg("raw").alias("raw"), F.count(F.lit(1)).alias("rows")).toPandas()
    share = share_of_cut(histogram["raw"].to_numpy(float), histogram["rows"].to_numpy(float))
    odds = F.col("raw") / F.greatest(F.lit(1.0) - F.col("raw"), F.lit(1e-12)) * F.lit(share / (1 - share))
    return scored.select("id", "source", (odds / (odds + 1)).alias("score"))
