"""Paging, lists of users, extra tags, name resolution by stages, exports and readers."""

import pytest
from pyspark.sql import functions as F

from tagsieve.operators import catalog, extras, profile, resolve, state, taglist
from tagsieve.session import ensure_checkpoint_dir
from tagsieve.sinks import writers
from tagsieve.sources import readers


def cards(spark, n):
    rows = [(i, f"name {i}", None, "a, b", None, i, None, "danbooru") for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, series string, tags string, image_url string, rank long, danbooru_tag string, source string")


@pytest.mark.parametrize("number,size,first,count", [(1, 30, 0, 30), ("2", 30, 30, 15), (99, 30, 30, 15), ("-3", "x", 0, 30), ("inf", 7, 0, 7), (None, None, 0, 30), ("2.9", 1000, 30, 15), (45, 0, 44, 1)])
def test_typed_pages(spark, number, size, first, count):
    got = [r["id"] for r in catalog.page_at(cards(spark, 45), number, size).collect()]
    assert got == list(range(first, first + count))


def test_empty_pages_and_cards(spark):
    none = cards(spark, 3).limit(0)
    assert catalog.page_at(none, 5).count() == 0
    assert [tuple(r) for r in catalog.row_at(none, 0).collect()] == [(None,) * 8]
    assert [r["id"] for r in catalog.row_at(cards(spark, 3), 2).collect()] == [2]
    assert [r["id"] for k in (-1, 3) for r in catalog.row_at(cards(spark, 3), k).collect()] == [None, None]


def test_appending_reads_underscores_as_blanks(spark):
    df = spark.createDataFrame([(["blue hair", "x", "x"], ["blue_hair", " BLUE HAIR", "Red_Eyes", "red eyes", ""])], "a array<string>, b array<string>")
    assert df.select(taglist.append_unique("a", "b")).first()[0] == ["blue hair", "x", "x", "Red_Eyes"]


def test_extras(spark):
    profiles = spark.createDataFrame(
        [("kai_lo", 1, "kai lo", 4), ("kai_lo", 2, "other girl", 4), ("kai_lo", 3, "Moon Circus", 3), ("kai_lo", 4, "blue hair", 0), ("kai_lo", 5, "2girls", 0), ("kai_lo", 6, "odd", 9), ("kai_lo", 7, "some artist", 1), ("kai_lo", 8, "", 0)],
        "seed_tag string, place int, tag string, category int",
    )
    entries = spark.createDataFrame(
        [(1, "Kai Lo", "Star Rail", "Blue Hair, solo, 1boy"), (2, " kai_lo ", None, None), (3, "nobody", "x", "y"), (4, "", None, ""), (5, "kai lo", "Moon_Circus", "kai lo, other girl, moon circus, blue hair, 2girls, odd, some artist")],
        "id long, seed string, series string, prompt string",
    )
    got = {r["id"]: r for r in extras.fetch(entries, extras.profile_lists(profiles)).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1]["c4"], got[1]["c3"], got[1]["c0"], got[1]["c1"], got[1]["c5"], got[1]["total"]) == (["kai lo", "other girl"], ["Star Rail", "Moon Circus"], ["2girls", "odd"], ["some artist"], [], 7)
    assert got[2]["c4"] == ["kai lo", "other girl"] and got[2]["total"] == 7
    assert got[5]["total"] == 0
    done = {r["id"]: (r["prompt"], r["added"]) for r in extras.apply_selected(extras.fetch(entries, extras.profile_lists(profiles))).collect()}
    assert done[1] == ("1boy, 2girls, kai lo, other girl, Star Rail, Moon Circus, Blue Hair, solo, odd, some artist", 7)
    assert done[5] == ("kai lo, other girl, moon circus, blue hair, 2girls, odd, some artist", 0)
    assert extras.fetch(entries.limit(0), extras.profile_lists(profiles)).count() == 0


def test_newest_posts_of_each_seed(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("seed_tag"), F.col("id").alias("post_id"))
    got = {r["seed_tag"]: (r["n"], r["low"]) for r in profile.sampled_posts(df, 500).groupBy("seed_tag").agg(F.count("*").alias("n"), F.min("post_id").alias("low")).collect()}
    assert got == {"hot": (200, 777), "cold": (100, 9)}
    assert profile.sampled_posts(df, 0).count() == 0


def test_tag_search_is_the_last_stage(spark):
    names = spark.createDataFrame([(1, "emma (promised farm)"), (2, "emma stone"), (3, "solo (x)"), (4, None), (5, "kai lo"), (6, "zz top")], "id long, name string")
    tags = spark.createDataFrame(
        [("emma_(lost_city)", 50), ("emma_(promised_farm_2)", 5), ("emma_stone_(actor)", 9), ("emma_stone_the_great", 9), ("solo_(y)", 7), ("kai_lo", 1), ("Big_ZZ_Top_band", 3), ("zz_topper", None)], "tag string, post_count long"
    )
    index = tags.select(F.lower("tag").alias("key"), F.col("tag").alias("canonical"))
    keyed = resolve.keys(names, spark.createDataFrame([], "antecedent_name string, consequent_name string"))
    stages = [lambda k: resolve.by_dictionary(k, index), lambda k: resolve.by_tag_search(names, k, tags, index)]
    got = {r["id"]: (r["tag"], r["strategy"]) for r in resolve.cascade(names, keyed, stages).collect()}
    assert got[5] == ("kai lo", "csv:full") and got[6] == ("Big ZZ Top band", "tag_search:full")
    assert got[2] == ("emma stone the great", "tag_search:full")  # equal words and posts: the last by letters
    assert got[1] == ("", "not_found") and got[3] == got[4] == ("", "not_found")
    found = {(r["key"], r["raw_tag"]) for r in resolve.candidates_of(keyed, tags).collect()}
    every = {r["key"] for r in keyed.collect()}
    assert found == {(k, t["tag"]) for k in every for t in tags.collect() if k in t["tag"].lower()}


def test_lists_of_users(spark):
    recents = spark.createDataFrame([(u, p, 100 * u + p) for u in (1, 2) for p in range(1, 36 if u == 1 else 4)], "user_id long, place int, item long")
    got = {u: sorted(r["place"] for r in state.recent_pages(recents, 2).collect() if r["user_id"] == u) for u in (1, 2)}
    assert got == {1: [31, 32, 33, 34, 35], 2: [1, 2, 3]}
    assert {r["user_id"] for r in state.cleared(recents, spark.createDataFrame([(1,), (1,)], "user_id long")).collect()} == {2}
    a, b = cards(spark, 3), cards(spark, 5)
    found = {r["id"]: r["place"] for r in state.first_of(spark.range(2, 9), a.select("id", "name"), b.select("id", "name")).collect()}
    assert found == {2: 0, 3: 1, 4: 1}
    value = writers.recents_json(recents.where("place <= 2 and user_id = 1"), cards(spark, 102)).first()["value"]
    assert value == '[{"id":101,"name":"name 101","series":"","tags":"a, b","danbooru_tag":"","image_url":"","source":"danbooru"},{"id":102,"name":"","series":"","tags":"","danbooru_tag":"","image_url":"","source":"danbooru"}]'


def test_cache_fold_by_search_equals_the_plain_fold(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("aab"), 1_700_000_000 + rng.randint(0, 40_000)) for _ in range(900)] + [("c", 1_700_000_000)] * 3 + [(None, 5)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    got = sorted((r["key"], r["at"].timestamp(), r["hit"]) for r in state.cache_use(df, "k", "at").collect())
    wanted, last = [], {}
    for k, s in sorted(r for r in rows if r[0]):
        hit = k in last and s - last[k] < 1800
        last[k] = last[k] if hit else s
        wanted.append((k, float(s), hit))
    assert got == sorted(wanted)


def test_wildcard_files(spark, tmp_path):
    rows = spark.createDataFrame([("Kai Lo!", " a, b "), ("kai lo", "c"), ("???", "d"), ("Empty", " "), (None, "x"), ("Second", "é\nf")], "name string, tags string")
    (tmp_path / "kept.txt").write_text("as it was")
    writers.write_wildcards(rows, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.glob("*.txt")} == {"kai_lo.txt": "c\n", "second.txt": "é\nf\n", "kept.txt": "as it was"}


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Name,Category,post_count,aliases\n"a_b",4,10,"x, y"\n"two\nlines",0,5,\na_b,0,7,"z"\nbroken,x,9,\n')
    got = [(r["tag"], r["category"], r["post_count"], r["aliases"]) for r in readers.read_dictionary(spark, str(tmp_path / "d.csv")).orderBy("line_no").collect()]
    assert got == [("a_b", 0, 7, ["z"]), ("two\nlines", 0, 5, []), ("broken", 0, 0, [])]
    assert readers.read_dictionary(spark, str(tmp_path / "missing.csv")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    def getCheckpointDir(self):
                        return type("O", (), {"isDefined": lambda s: False})()

                return S()

        def getConf(self):
            return Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context(), "conf": Conf()})())
