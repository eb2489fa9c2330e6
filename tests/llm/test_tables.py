"""Hidden copies, term frequencies, pairs and cut texts against brute force on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagsieve.llm import cooccur, copies, termfreq, truncation


def catalog_rows(n, seed=3):
    rng = random.Random(seed)
    names = ["Ann Bell", "bell, ann", "ann_bell", "Cy Dor", "cy-dor", None, ""]
    sources = ["danbooru", "Danbooru.", None, "e621", "E-621"]
    tags = [["a", "B c"], ["b_c", "A", "a"], ["x"], [], ["X", "y\\"], ["ａ"]]
    return [(i, rng.choice(sources), rng.choice(names), rng.choice(tags)) for i in range(n)]


def brute_copies(rows):
    groups = defaultdict(list)
    for i, source, name, tags in rows:
        key = ("".join(c for c in (source or "danbooru").lower() if c.isalnum()), tuple(sorted(re.findall(r"[^\W_]+", (name or "").lower()))), frozenset(" ".join(t.lower().replace("_", " ").replace("\\", "").split()) for t in tags))
        groups[key].append(i)
    return groups


def test_copies(spark):
    rows = catalog_rows(400)
    df = spark.createDataFrame(rows, "id long, source string, name string, vals array<string>").withColumn("key", F.lit("clash"))
    encoded = copies.encoded_records(df)
    groups = brute_copies(rows)
    got = sorted(tuple(r) for r in copies.copy_members(encoded).collect())
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    counted = sorted((r["first_id"], r["copies"]) for r in copies.copy_groups(encoded).collect())
    assert counted == sorted((min(g), len(g)) for g in groups.values())


def test_copies_hot_group_null_ids_and_empty(spark):
    schema = "id long, source string, name string, vals array<string>"
    hot = [(i, None, "same", ["t"]) for i in range(2000)] + [(7, None, "same", ["t"]), (None, None, "same", ["t"]), (None, None, "only null", ["t"]), (None, None, "only null", ["t"])]
    got = copies.copy_members(copies.encoded_records(spark.createDataFrame(hot, schema)))
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 2000)) and {r["first_id"] for r in got.collect()} == {0}
    assert copies.copy_members(copies.encoded_records(spark.createDataFrame([], schema))).count() == 0


def test_term_frequencies(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["tags", "series", None]), rng.choice(["a", "b", "c d", "", None, "é"]), rng.choice([1, 2, 3, None])) for _ in range(3000)] + [("tags", "hot", i) for i in range(5000)] + [("tags", "hot", 5), ("tags", "once", 9)]
    df = spark.createDataFrame(rows, "field string, term string, rec_id long").withColumn("records", F.lit(1))
    kept = [r for r in rows if r[0] is not None and r[1]]
    wanted = {(f, t): (sum(1 for r in kept if r[:2] == (f, t)), len({r[2] for r in kept if r[:2] == (f, t)})) for f, t in {r[:2] for r in kept}}
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in termfreq.term_frequencies(df).collect()}
    assert got == wanted
    assert termfreq.term_frequencies(df.limit(0)).count() == 0
    named = df.withColumn("rec_id", F.concat(F.lit("r"), F.col("rec_id")))
    assert {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in termfreq.term_frequencies(named).collect()} == wanted
    marks = spark.createDataFrame([(2,), (3,), (8,), (7,)], "k long").select("k", termfreq.usefulness(F.col("k"), F.lit(100)).alias("m")).collect()
    assert {r["k"]: r["m"] for r in marks} == {2: "rare", 3: None, 8: "common", 7: None}


def test_runs_carry_over_batches():
    import pyarrow as pa

    pairs = [("f", "a", 1), ("f", "a", 1), ("f", "a", 2), ("f", "b", 1), ("g", "b", 1), ("g", "b", 1)]
    for cut in range(len(pairs) + 1):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("field", "term", "rec_id"), p)) for p in part], schema=pa.schema([("field", pa.string()), ("term", pa.string()), ("rec_id", pa.int64())])) for part in (pairs[:cut], pairs[cut:])]
        total = Counter()
        records = Counter()
        for b in termfreq._runs(iter(batches)):
            for r in b.to_pylist():
                total[r["field"], r["term"]] += r["occurrences"]
                records[r["field"], r["term"]] += r["records"]
        assert total == {("f", "a"): 3, ("f", "b"): 1, ("g", "b"): 2} and records == {("f", "a"): 2, ("f", "b"): 1, ("g", "b"): 1}


def test_pair_counts(spark):
    rng = random.Random(2)
    baskets = [sorted(set(rng.choices("abcdefghij", weights=[9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 6)))) for _ in range(500)] + [None, [], ["a"], [f"i{k}" for k in range(2500)]] * 2
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    single, pair = Counter(), Counter()
    for b in baskets:
        single.update(b or [])
        pair.update(itertools.combinations(sorted(b or []), 2))
    wanted = {(a, b, single[a], single[b], n) for (a, b), n in pair.items() if n >= 5}
    got = {tuple(r) for r in cooccur.pair_counts(df, 5).collect()}
    assert got == wanted
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cooccur, "MOST_ITEMS", 2)
        with pytest.raises(ValueError):
            cooccur.pair_counts(df, 5)
    capped = {tuple(r) for r in cooccur.pair_counts(df, 5, max_rows=150).collect()}
    assert capped == {w for w in wanted if max(w[2], w[3]) <= 150}
    long = {tuple(r) for r in cooccur.pair_counts(df.where(F.size("items") > 2000), 2).where("item_a < 'i1002'").collect()}
    ids = sorted(f"i{k}" for k in range(2500))
    assert len(long) == sum(len(ids) - 1 - k for k, i in enumerate(ids) if i < "i1002")


def test_null_model_keeps_margins_and_tails_are_close():
    degrees, items, sizes, rows = np.array([3.0, 10, 40]), np.array([20.0, 8, 3]), np.array([1.0, 4, 7]), np.array([25.0, 35, 15])
    scale = (degrees * items).sum() / (sizes * rows).sum()
    degrees = degrees / scale
    x, y = cooccur.fit_null(degrees, items, sizes, rows)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ rows, degrees, rtol=1e-6) and np.allclose(items @ p, sizes, rtol=1e-6)
    pairs, counts = p[[2, 2]] * p[[2, 1]], np.array([25.0, 14.0])
    mean, tail = cooccur.log_tail(counts, pairs, rows)
    for k in range(2):
        exact = np.array([1.0])
        for q, m in zip(pairs[k], rows):
            for _ in range(int(m)):
                exact = np.convolve(exact, [1 - q, q])
        assert abs(mean[k] - (exact * np.arange(len(exact))).sum()) < 1e-9
        assert abs(tail[k] - np.log10(exact[int(counts[k]) :].sum())) < 0.05 + 0.05 * abs(tail[k])


def test_surprise_lists_every_pair_with_its_values(spark):
    rng = random.Random(4)
    baskets = [sorted({*rng.sample("abcdefgh", 3), *(["x", "y"] if rng.random() < 0.1 else [])}) for _ in range(600)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    rows = {(r["item_a"], r["item_b"]): r for r in cooccur.pair_surprise(df, 5).collect()}
    assert set(rows) == {(r["item_a"], r["item_b"]) for r in cooccur.pair_counts(df, 5).collect()}
    assert rows["x", "y"]["q"] < 1e-6 and rows["a", "b"]["q"] > 0.01 and rows["x", "y"]["expected"] < rows["x", "y"]["n_ab"]
    assert cooccur.pair_surprise(df.limit(0), 5).count() == 0


def test_surprise_keeps_every_frequency_and_size(spark):
    """More distinct frequencies and basket sizes than 256: expected counts are those of the fit on all of them."""
    rng = np.random.default_rng(5)
    held = rng.random((900, 700)) < np.outer(np.linspace(0.02, 0.98, 900), np.linspace(0.02, 1, 700) ** 1.4)
    held[:, 699] |= rng.random(900) < 0.9
    df = spark.createDataFrame([([f"i{k:03}" for k in np.flatnonzero(b)],) for b in held], "items array<string>")
    (degrees, items), (sizes, rows) = (np.unique(n[n > 0], return_counts=True) for n in (held.sum(0), held.sum(1)))
    assert len(degrees) > 256 and len(sizes) > 256
    x, y = cooccur.fit_null(degrees, items, sizes, rows)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ rows, degrees, rtol=1e-6) and np.allclose(items @ p, sizes, rtol=1e-6)
    got = cooccur.pair_surprise(df, 260).collect()
    assert any(r["item_b"] == "i699" for r in got)
    for r in got:
        a, b = (p[np.flatnonzero(degrees == r[c])[0]] for c in ("n_a", "n_b"))
        assert abs(r["expected"] - (a * b) @ rows) < 1e-6 * r["expected"]


def test_false_discovery_values_count_every_pair_that_could_be_listed(spark):
    """Pairs of frequent items that are counted but stay below the least count are tests too."""
    rng = random.Random(6)
    baskets = [sorted({*rng.sample([f"t{k:02}" for k in range(60)], 3), *(["x", "y"] if rng.random() < 0.03 else [])}) for _ in range(600)] + [["rare", None]] * 4
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    for most in (None, 30):
        single = Counter(t for b in baskets for t in b if t)
        kept = [t for t, n in single.items() if 5 <= n <= (most or n)]
        tests = len(kept) * (len(kept) - 1) // 2
        rows = cooccur.pair_surprise(df, 5, most).collect()
        assert 0 < len(rows) < tests / 5
        for r in rows:  # each q is at least the smallest of tail * tests / rank from there on
            later = [o for o in rows if o["log10_p"] >= r["log10_p"]]
            exact = min(min(10 ** o["log10_p"] * tests / sum(p["log10_p"] <= o["log10_p"] for p in rows) for o in later), 1)
            assert exact * (1 - 1e-9) <= r["q"] <= exact * 10**0.0101


VALUES = [f"{a} {b}" for a in ("blue", "red", "long", "short", "ivory", "mint") for b in ("hair", "eyes", "scarf", "gloves", "lantern")] + ["seated", "standing", ":|"]


def test_cut_texts(spark):
    """Held-out cuts are found and intact lists with misprinted, unlisted and punctuated ends are not."""
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(3000):
        vals = rng.sample(VALUES, rng.randint(5, 12))
        if rng.random() < 0.4:
            vals[rng.choice([-1, 0, 2, 3])] = rng.choice([f"custom {rng.choice('abcdef')}{rng.randint(0, 99)} totem", "mitn scarf", ":|"])
        text = ", ".join(vals)
        if i % 20 == 0:
            k = len(vals) - 2
            keep = ", ".join(vals[:k])
            kind = i // 20 % 3
            part = vals[k][: max(1, len(vals[k]) - 3)] if len(vals[k]) > 4 and vals[k] not in ("seated", "standing") else "blu"
            if kind == 0:
                text, vals = f"{keep}, {part}", [*vals[:k], part]
            elif kind == 1:
                text, vals = f"{keep}, ", vals[:k]
            else:
                text, vals = f"{keep}, {part}…", [*vals[:k], part + "…"]
            cut.add(i)
        rows.append((i, None if i % 2 else "E621", text, vals))
    rows += [(9000, None, None, []), (9001, None, " ", []), (9002, "x", "one", ["one"])]
    df = spark.createDataFrame(rows, "id long, source string, text string, vals array<string>").withColumn("piece", F.lit(0))
    words = spark.createDataFrame([(v,) for v in VALUES], "term string")
    scores = {r["id"]: (r["source"], r["score"]) for r in truncation.cut_scores(df, words).collect()}
    assert set(scores) == {r[0] for r in rows} - {9000, 9001}
    found = {i for i, (_, s) in scores.items() if s > 0.5}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(cut)
    assert scores[0][0] == "e621" and scores[1][0] == "danbooru"


def test_cut_texts_of_tiny_and_empty_tables(spark):
    schema = "id long, source string, text string, vals array<string>"
    words = spark.createDataFrame([("a",)], "term string")
    assert truncation.cut_scores(spark.createDataFrame([], schema), words).count() == 0
    assert truncation.cut_scores(spark.createDataFrame([(1, None, "a, b", ["a", "b"])], schema), words.limit(0)).count() == 1


def test_limits(spark):
    df = spark.createDataFrame([("s", "x" * n) for n in [*range(20, 60), *[40] * 30]], "source string, text string")
    assert [tuple(r) for r in truncation.length_limits(df).collect()] == [("s", 40)]


def test_copies_of_hot_groups_are_salted_by_size(spark):
    rows = [(i, "E621" if i % 2 else "e621", "A b" if i % 3 else "b_a", ["x", "y_z"] if i % 5 else ["Y z", "x"]) for i in range(700)]
    rows += [(1000 + i, None, f"n{i // 3}", ["x"]) for i in range(60)] + [(5, "e621", "a b", ["x", "y z"])]
    df = spark.createDataFrame(rows, "id long, source string, name string, vals array<string>")
    got = sorted(tuple(r) for r in copies.copy_members(copies.encoded_records(df), hot=50).collect())
    assert got == sorted([(0, i) for i in range(1, 700)] + [(1000 + 3 * k, 1000 + 3 * k + j) for k in range(20) for j in (1, 2)])


def test_tuples_that_agree_in_64_bits_stay_apart(spark, monkeypatch):
    """Identifiers that clash in their first half are told apart by the check."""
    rows = spark.createDataFrame([(1, 1, 2, [3], 7, 9), (2, 1, 2, [3], 8, 9), (3, 1, 2, [3], 7, 9)], "id long, source_id long, name_id long, tag_ids array<long>, check long, key long")
    assert [tuple(r) for r in copies.copy_members(rows).collect()] == [(1, 3)]
