"""Mapping of typed values to the canonical list."""

import random

import pytest
from pyspark.sql import functions as F

from tagsieve.llm import canonical
from tagsieve.llm import queries as llm

ENTRIES = [
    ("star_rail:_after_rain", 3, "star_rail:_after_rain", 50),
    ("star_rail:_after_rain", 3, "srar", 50),
    ("moon_circus", 3, "moon_circus", 10),
    ("moon_circus_ii", 3, "moon_circus_ii", 5),
    ("velka_rosmarin", 4, "velka_rosmarin", 9),
    ("velka_rosmarin", 4, "ヴェルカ・ロスマリン", 9),
    ("velka_rosmarin", 4, "jade_bell,_waving_novi", 9),
    ("todora_quill_(moon_circus)", 4, "todora_quill_(moon_circus)", 3),
    ("todora_quill_(star_rail:_after_rain)", 4, "todora_quill_(star_rail:_after_rain)", 8),
    ("brindamora", 4, "brindamora", 4),
]


@pytest.fixture(scope="module")
def matcher():
    return canonical.Matcher(ENTRIES)


@pytest.mark.parametrize(
    "value,series,wanted",
    [
        ("Velka Rosmarin", None, "velka_rosmarin"),
        ("rosmarin, VELKA", "", "velka_rosmarin"),
        ("★ velka_rosmarin ★", None, "velka_rosmarin"),
        ("ｖｅｌｋａ　ｒｏｓｍａｒｉｎ", None, "velka_rosmarin"),
        ("vélkâ rosmarín!", None, "velka_rosmarin"),
        ("velkarosmarin", None, "velka_rosmarin"),
        ("vekla rosmrain", None, "velka_rosmarin"),
        ("ゔぇるか・ろすまりん", None, "velka_rosmarin"),
        ("Jade Bell, Waving Novi", None, "velka_rosmarin"),
        ("Velka Rosmarin (from Moon Circus)", None, "velka_rosmarin"),
        ("Velka Rosmarin - fan art", None, "velka_rosmarin"),
        ("Lady Brindamora", None, "brindamora"),
        ("brindamora-chan", None, "brindamora"),
        ("Todora Quill", "The Moon Circus (anime)", "todora_quill_(moon_circus)"),
        ("todora quil", "SRAR", "todora_quill_(star_rail:_after_rain)"),
        ("todora quill \\(moon circus\\)", "unknown", "todora_quill_(moon_circus)"),
        ("Todora Quill", None, "todora_quill_(star_rail:_after_rain)"),
        ("unknown", "moon circus", ""),
        ("nobody special", "moon circus", ""),
        ("???", None, ""),
    ],
)
def test_names(matcher, value, series, wanted):
    assert matcher.resolve("name", value, series) == wanted


def test_long_titles_in_another_order():
    many = "a tale of nine paper ships that crossed one frozen river before dawn came"
    titles = ["the_last_garden_beneath_winter_glass", "the_last_garden_beneath_summer_glass", many.replace(" ", "_")]
    matcher = canonical.Matcher([(t, 3, t, 5) for t in titles])
    rng = random.Random(1)
    for title in titles:
        for _ in range(30):
            parts = title.split("_")
            rng.shuffle(parts)
            assert matcher.resolve("series", " ".join(parts), None) == title
            at = max(range(len(parts)), key=lambda k: len(parts[k]))
            parts[at] = parts[at][:2] + parts[at][3:]
            assert matcher.resolve("series", " ".join(parts), None) == title
            added = [*title.split("_"), "another"]
            rng.shuffle(added)
            assert matcher.resolve("series", " ".join(added), None) == title
            rng.shuffle(missing := title.split("_")[:-1])
            assert matcher.resolve("series", " ".join(missing), None) == title
    assert matcher.resolve("series", "glass winter beneath garden two others", None) == ""
    assert matcher.resolve("series", "winter glass winter garden last the", None) == ""


@pytest.mark.parametrize("value,wanted", [("Star Rail - After Rain", "star_rail:_after_rain"), ("moon-circus", "moon_circus"), ("mooncircus", "moon_circus"), ("the moon circus ii", "moon_circus_ii"), ("moon circsu", "moon_circus"), ("SRAR", "star_rail:_after_rain"), ("n/a", ""), ("moon", "")])
def test_series(matcher, value, wanted):
    assert matcher.resolve("series", value, None) == wanted


def test_one_word_more_is_too_much_for_short_names(matcher):
    assert matcher.resolve("name", "velka rosmarin ostrava", None) == "" and matcher.resolve("name", "brindamora ostrava", None) == ""


def test_token_sets_equal_brute_force():
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    forms = sorted({tuple(rng.sample(stock, rng.randint(3, 9))) for _ in range(200)})
    index = canonical.Names([(" ".join(f), " ".join(f), "", 1) for f in forms])

    def alike(a, b):
        """(edits) between two token sets by trying all pairings of what they do not share, or None."""
        from collections import Counter
        from itertools import permutations

        mine, theirs = Counter(a), Counter(b)
        fewer, more = sorted((list((mine - theirs).elements()), list((theirs - mine).elements())), key=len)
        unpaired, allowed = len(more) - len(fewer), canonical.most_edits(min(sum(map(len, a)), sum(map(len, b))))
        if unpaired > 0.2 * max(len(a), len(b)) + 1e-9 or len(fewer) > allowed:
            return None
        d = min(sum(canonical.edits(x, y, 9) for x, y in zip(fewer, p)) for p in permutations(more, len(fewer)))
        return d + 3 * unpaired if d <= allowed else None

    for _ in range(400):
        words = list(rng.choice(forms))
        rng.shuffle(words)
        if rng.random() < 0.4:
            words.append(rng.choice(stock))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(words))
            words[k] = words[k][:1] + rng.choice("xyz") + words[k][1:]
        fits = {f: d for f in forms if (d := alike(words, f)) is not None}
        wanted = sorted((d, f) for f, d in fits.items() if d == min(fits.values()))
        joined = [x for x in index.similar(words) if x not in wanted]
        got = index.similar(words)
        assert got == wanted or joined and got[0][0] < min(fits.values(), default=99) + 1, words


def test_similarity_equals_brute_force():
    rng = random.Random(1)
    names = ["".join(rng.choice(["ka", "lo", "mi", "tur", "es", "no"]) for _ in range(rng.randint(2, 6))) for _ in range(300)]
    index = canonical.Names([(n, n, "", 1) for n in names])
    for _ in range(300):
        text = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["x"], [text[at], "y"]])
        query = "".join(text)
        if not query:
            continue
        fits = {n: canonical.edits(query, n, 9) for n in set(names)}
        fits = {n: d for n, d in fits.items() if d <= canonical.most_edits(min(len(n), len(query)))}
        wanted = sorted((d, (n,)) for n, d in fits.items() if d == min(fits.values()))
        assert index.similar([query]) == wanted


def test_frame(spark):
    rows = [(1, "Velka Rosmarin", "moon circus", None), (1, "Velka Rosmarin", "moon circus", None), (2, None, " ", "brindmora"), (3, "", None, "")]
    df = spark.createDataFrame(rows, "id long, name string, series string, danbooru_tag string").withColumn("tag", F.lit("clash")).withColumn("field", F.lit(1))
    got = sorted(tuple(r) for r in canonical.map_values(df, "id", ["name", "series", "danbooru_tag"], "series", ENTRIES).collect())
    assert got == [(1, "name", "velka_rosmarin")] * 2 + [(1, "series", "moon_circus")] * 2 + [(2, "danbooru_tag", "brindamora")]
    assert {r["tag"] for r in canonical.map_values(df, "id", ["name", "series"], "series", []).collect()} == {""}
    assert canonical.map_values(df.limit(0), "id", ["name"], "series", ENTRIES).count() == 0


def test_entries_follow_redirects(spark):
    tags = spark.createDataFrame([("a_tag", 4, 5, 1), ("a_tag", 4, None, 2), ("series_x", 3, 1, 3), ("hair", 0, 9, 4)], "tag string, category int, post_count long, line_no long")
    aliases = spark.createDataFrame([("a_tag", "first"), ("hair", "h")], "tag string, alias string")
    moves = spark.createDataFrame([("old", "older"), ("older", "a_tag"), ("loop", "pool"), ("pool", "loop"), ("gone", "nowhere"), ("h", "hair"), ("old_first", "first")], "antecedent_name string, consequent_name string")
    got = canonical.canonical_entries(tags, aliases, moves)
    assert got == sorted([("a_tag", 4, f, 5) for f in ("a_tag", "first", "old", "older", "old_first")] + [("series_x", 3, "series_x", 1)])
    twice = spark.createDataFrame([("x", "series_x"), ("x", "a_tag"), ("y", "both")], "antecedent_name string, consequent_name string")
    both = aliases.union(spark.createDataFrame([("series_x", "both"), ("a_tag", "both")], aliases.schema))
    found = {f: tag for tag, _, f, _ in canonical.canonical_entries(tags, both, twice)}
    assert found["x"] == "a_tag" and found["y"] == "a_tag"


def test_unmatched_values_are_listed_with_their_rows(spark, small):
    mapped = llm.QUERIES["p1_found"](spark, small)
    listed = llm.QUERIES["p1_unmatched"](spark, small)
    assert listed.columns == ["field", "value", "rows"]
    assert listed.agg(F.sum("rows")).first()[0] == mapped.where("tag = ''").count() > 0


def test_registered_queries_run_on_the_smallest_tables(spark, small):
    for name in ("p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p8_found", "p9_found"):
        assert llm.QUERIES[name](spark, small).count() > 0, name
    sources = llm.QUERIES["p2_sources"](spark, small).collect()
    assert sum(r["rows"] for r in sources) > 200 and all(0 <= r["share"] <= 1 for r in sources)
