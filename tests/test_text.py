"""String functions against small Python versions and the golden cases of the survey."""

import random
import re
import sqlite3

from pyspark.sql import functions as F

from tagsieve.functions import text as T


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    rows = {r["i"]: r["y"] for r in df.select("i", column.alias("y")).collect()}
    return [rows[i] for i in range(len(values))]


def test_like_agrees_with_sqlite(spark):
    rng = random.Random(1)
    alphabet = "abAB%_\\( É"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(200)]
    terms = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2))) for _ in range(12)]
    db = sqlite3.connect(":memory:")
    for term in terms:
        wanted = [bool(db.execute("SELECT ? LIKE ?", (v, f"%{term}%")).fetchone()[0]) for v in values]
        assert apply(spark, T.like_contains("x", term), values) == wanted
        assert apply(spark, T.like_contains("x", F.lit(term)), values) == wanted


def test_title_agrees_with_python(spark):
    values = ["re:zero", "jojo's ADVENTURE", "élan vital", "abc (x)", "", "a1b c", "LOUD 2nd"]
    assert apply(spark, T.title("x"), values) == [v.title() for v in values]


def test_strip_knows_all_blanks(spark):
    values = ["　a b \n", "\t\x85x ", "", " ", "plain"]
    assert apply(spark, T.strip("x"), values) == [v.strip() for v in values]


def test_names(spark):
    assert apply(spark, T.file_name("x"), [" Sakura (Street Fighter)", "a" * 80, None]) == ["sakura_street_fighter", "a" * 50, ""]
    assert sorted(apply(spark, T.meaningful_words("x"), ["emma (the promised neverland)"])[0]) == ["emma", "neverland", "promised"]
    assert apply(spark, T.inverted("x"), ["kaguya shinomiya", "one", "a (b)", "a b c"]) == ["shinomiya kaguya", "", "", ""]
    assert apply(spark, T.without_suffix("x"), ["black swan (honkai: star rail)", "plain"]) == ["black swan", "plain"]
    assert apply(spark, T.suffix("x"), ["black swan (honkai: star rail)", "plain"]) == ["honkai: star rail", ""]
    assert apply(spark, T.unescape_brackets("x"), ["2b \\(nier:automata\\) "]) == ["2b (nier:automata)"]
    assert apply(spark, T.plain_form("x"), [" A_b\\  C\n"]) == ["a b c"]
    assert T.search_terms("miku, vocaloid ,") == ["miku", "vocaloid"]


def test_glob(spark):
    import fnmatch

    values = ["blue_hair", "hair", "blond_hat", "a.b", "a[b", "x^y", "blue_hair_x"]
    for pattern in ["*hair", "*_ha?r", "[!b]*", "a.b", "a[[]b", "x[^y]y", "*", "blue_*"]:
        wanted = [fnmatch.fnmatchcase(v, pattern) for v in values]
        assert apply(spark, F.col("x").rlike(T.glob_regex(pattern)), values) == wanted, pattern


def test_source_key(spark):
    assert apply(spark, T.source_key("x"), ["E-621.", None, " Danbooru "]) == ["e621", "danbooru", "danbooru"]
    assert re.sub(r"\W", "", "E-621") == "E621"
