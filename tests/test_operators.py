"""Catalog, dictionary, tag lists, cleaning, state on rows made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagsieve.operators import cards, catalog, cleaning, dictionary, profile, resolve, state, taglist
from tagsieve.sinks import writers
from tagsieve.sources import readers

CATALOG = "id long, name string, series string, tags string, image_url string, rank long, danbooru_tag string, source string"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "blue hair", "Alpha", "x, y", None, None, None, None),
        (2, "BLUE_HAIR", "alpha", "x", None, 2, "", "b"),
        (3, "2b \\(nier\\)", "", "blue hair", None, 2, "x y", "a"),
        (4, "Élan", None, "50% off", None, 1, "t", "a"),
    ]
    return catalog.with_default_source(spark.createDataFrame(data, CATALOG))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_search(spark, rows):
    assert ids(catalog.search(rows, "blue_hair")) == [1, 2, 3]
    assert ids(catalog.search(rows, "\\(nier, BLUE")) == [3]
    assert ids(catalog.search(rows, "élan")) == []
    assert ids(catalog.search(rows, "%")) == [1, 2, 3, 4]
    assert ids(catalog.search(rows, series="ALPHA")) == [1, 2]
    assert ids(catalog.search(rows, series="All", tag_status="Missing")) == [1, 2]
    assert ids(catalog.search(rows, tag_status="Has", source="a")) == [3, 4]
    empty = spark.createDataFrame([], "id long")
    assert ids(catalog.search(rows, ids=empty)) == []
    assert ids(catalog.search(rows, ids=spark.createDataFrame([(2,), (2,), (9,)], "id long"))) == [2]


def test_pages(rows):
    assert [r["id"] for r in catalog.page(rows, 1, 3).collect()] == [1, 4, 2]
    assert [r["id"] for r in catalog.page(rows, 2, 3).collect()] == [3]
    assert catalog.totals(rows.limit(0)).first()[:] == (0, 1)
    assert catalog.totals(rows, 3).first()[:] == (4, 2)


def test_batch_agrees_with_single_searches(spark, rows):
    queries = ["blue hair", "x", "nier, off", " , "]
    df = spark.createDataFrame([(q,) for q in queries], "query string")
    got = sorted(tuple(r) for r in catalog.search_batch(rows, df).collect())
    wanted = sorted((q, i) for q in queries if q.strip(" ,") for i in ids(catalog.search(rows, q)))
    assert got == wanted
    with pytest.raises(ValueError):
        catalog.search_batch(rows, df, most_terms=1)


def test_search_of_any_number_of_queries_agrees_with_single_searches(spark, rows, monkeypatch):
    queries = ["blue hair", "BLUE", "x", "nier, off", "50%", "b_ue %r", "%", "__", "____________", "\\\\(n", "é", "É", "blue x", "x x X", "none", "", " , "]
    df = spark.createDataFrame([(q,) for q in [*queries, "x", None]], "query string")
    wanted = sorted((q, i) for q in queries if q.strip(" ,") for i in ids(catalog.search(rows, q)))
    monkeypatch.setattr(catalog, "PAIRS", 3)
    for block in (1, 4, 1000):
        assert sorted(tuple(r) for r in catalog.search_all(rows, df, block).collect()) == wanted
    assert catalog.search_all(rows, df.limit(0)).count() == 0


def test_every_typed_search_is_run(spark, small):
    """Brute force over all typed searches."""
    from tagsieve.plans import queries

    typed = {r["query"] for r in queries._typed(spark, small).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r["id"], [r[c].translate(low) for c in catalog.SEARCHED if r[c] is not None]) for r in queries.cat(spark, small).collect()]
    wanted = {}
    for q in typed:
        terms = [t.translate(low) for t in q.replace(",", " ").split()]
        assert not any(c in q for c in "%_")
        found = [i for i, held in texts if terms and all(any(t in x for x in held) for t in terms)]
        if found:
            wanted[q] = (len(found), min(found))
    assert len(wanted) > 20
    assert {r["query"]: (r["hits"], r["first_id"]) for r in queries.QUERIES["catalog_search_all"](spark, small).collect()} == wanted


def test_cut_tags_are_completed_by_tags_of_any_length(spark):
    long = "quiet_" + "w" * 70 + "_lantern"
    words = spark.createDataFrame([(long, 900), ("blue_hair", 5000)], "tag string, post_count long")
    rows = spark.createDataFrame([(1, "blue hair, quiet " + "w" * 40), (2, "blue ha")], "id long, tags string")
    got = {r["id"]: (r["fixed"], r["action"]) for r in cleaning.repair_tags(rows, words).collect()}
    assert got == {1: ("blue hair, " + long.replace("_", " "), "completed"), 2: ("blue hair", "completed")}


def test_changes(spark, rows):
    incoming = spark.createDataFrame([(10, "n", None, "t", None, 2, None, "c"), (11, "n", None, "t", None, 7, None, "c"), (12, "n", None, "t", None, 7, None, "c"), (13, "n", None, "t", None, None, None, "c"), (14, None, None, "t", None, 8, None, "c")], CATALOG)
    assert ids(catalog.insert_or_ignore(rows, incoming)) == [1, 2, 3, 4, 11, 13]
    updates = spark.createDataFrame([(1, "new"), (4, None), (99, "z")], "id long, danbooru_tag string")
    after = catalog.apply_updates(rows, updates, ["danbooru_tag"])
    assert {r["id"]: r["danbooru_tag"] for r in after.collect()} == {1: "new", 2: "", 3: "x y", 4: None}
    assert ids(catalog.changed_only(rows, after, ["danbooru_tag"])) == [1, 4]


def test_numbering_and_sample(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("id"))
    got = {r["id"]: r["position"] for r in catalog.numbered(df, "id").collect()}
    assert got == {i: i for i in range(1000)}
    assert [r["id"] for r in catalog.systematic_sample(df, 4, "id").orderBy("id").collect()] == [0, 250, 500, 750]


def test_dictionary(spark):
    raw = spark.createDataFrame([(1, " blazer ", 0, 10, "a, ,b"), (2, "yor_briar", 4, 5, "yor_forger"), (3, "blazer", 0, 20, None), (4, "", 0, 1, None), (5, "odd", None, 9, None), (6, "yor_forger_x", 4, 7, "yor_forger")], "line_no long, tag string, category int, post_count long, aliases string")
    d = dictionary.load(raw)
    rows = {r["tag"]: (r["line_no"], r["category"], r["post_count"], r["aliases"], r["category_name"]) for r in d.collect()}
    assert rows["blazer"] == (1, 0, 20, [], "general") and rows["odd"] == (5, 0, 0, [], "general") and len(rows) == 4
    found = {r["wanted"]: (r["tag"], r["by_alias"]) for r in dictionary.lookup(d, spark.createDataFrame([("yor_forger",), ("blazer",), ("none",)], "wanted string")).collect()}
    assert found == {"yor_forger": ("yor_briar", 1), "blazer": ("blazer", 0)}
    assert [r["tag"] for r in dictionary.search(d, "BLA*", 1).collect()] == ["blazer"]
    assert [r["tag"] for r in dictionary.ranked_search(d, "yor").collect()] == ["yor forger x", "yor briar"]
    assert dictionary.ranked_search(d, "  ").collect() == []
    new = spark.createDataFrame([("blazer", 3, 1, 0), ("fresh", 4, 2, 1)], "name string, category int, post_count long, seq long")
    after = {r["tag"]: (r["line_no"], r["category"], r["post_count"]) for r in dictionary.upsert(d, new).collect()}
    assert after["blazer"] == (1, 3, 1) and after["fresh"] == (8, 4, 2)
    links = dictionary.wiki_links(spark.createDataFrame([(1, "x [[Blue hair|b]] y [[red_hair]]"), (2, None)], "id long, t string"), "id", "t")
    assert [r["link"] for r in links.orderBy("pos").collect()] == ["blue_hair", "red_hair"]


def test_profile(spark):
    now = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([("s", 1, "a b highres", "c", "y", None, now), ("s", 2, "b", "c", "", None, now), ("s", 2, "zzz", "", "", None, now - dt.timedelta(1)), ("o", 3, None, None, None, "q q r", now)], "seed_tag string, post_id long, tag_string_general string, tag_string_character string, tag_string_copyright string, tag_string string, fetched_at timestamp")
    p = profile.profiles(profile.latest_posts(posts))
    got = [(r["seed_tag"], r["place"], r["tag"], r["count"], r["frequency"]) for r in p.orderBy("seed_tag", "place").collect()]
    assert got == [("o", 1, "q", 2, 2.0), ("o", 2, "r", 1, 1.0), ("s", 1, "c", 2, 1.0), ("s", 2, "y", 1, 0.5), ("s", 3, "b", 2, 1.0), ("s", 4, "a", 1, 0.5)]


def test_tag_lists(spark):
    df = spark.createDataFrame([(["a", "A"], ["b", "a_", "a"])], "x array<string>, y array<string>")
    assert df.select(taglist.append_unique("x", "y")).first()[0] == ["a", "A", "b", "a_"]
    assert df.select(taglist.unique(F.array(F.lit("a_b"), F.lit("A b"), F.lit("c"), F.lit(" ")))).first()[0] == ["a_b", "c"]
    assert df.select(taglist.move_to_front(F.lit("b"), F.array(F.lit("a"), F.lit("b")), 20)).first()[0] == ["b", "a"]
    assert df.select(taglist.with_head(F.array(F.lit("a")), F.lit("A"))).first()[0] == ["a"]
    rows = spark.createDataFrame([(1, "blue hair, 1girl, miku, 2boys, vocaloid")], "id long, tags string")
    lookup = spark.createDataFrame([("miku", 4), ("vocaloid", 3)], "tag string, category int")
    assert taglist.in_class_order(rows, "id", "tags", lookup).first()["ordered"] == "2boys, 1girl, miku, vocaloid, blue hair"


def test_series_cleaning(spark):
    data = [("abc \\(y\\)", "black swan (honkai)", "", "Abc", "Honkai"), ("x \\(y\\)", "black swan (honkai)", "", "x \\(y\\)", "Honkai"), ("miku", None, "miku, vocaloid, 1girl", "miku", "Vocaloid"), ("saber", "fate (series)", "", "Saber", "Fate"), ("n", "", None, "n", "")]
    df = spark.createDataFrame([(i, *d[:3]) for i, d in enumerate(data)], "id long, name string, series string, tags string")
    got = {r["id"]: (r["new_name"], r["new_series"]) for r in cleaning.clean_series(df).collect()}
    assert got == {i: d[3:] for i, d in enumerate(data)}


def test_repair(spark):
    words = spark.createDataFrame([("blue_eyes", 16_000_000), ("blue_eyeshadow", 600), ("blue_ey", 100), ("a", 1), ("b", 1)], "tag string, post_count long")
    cases = [("a, b,", "a, b", "strip_comma"), ("x, blue e", "x, blue eyes", "completed"), ("1girl, xq", "1girl", "removed"), ("1girl, xqz", "1girl, xqz", "ok"), ("", "", "ok"), (None, None, "ok"), ("x, blue eyes", "x, blue eyes", "ok")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, tags string")
    got = {r["id"]: (r["fixed"], r["action"]) for r in cleaning.repair_tags(df, words).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_resolution(spark):
    names = spark.createDataFrame([(1, "kaguya shinomiya"), (2, "black swan (hsr)"), (3, "nobody"), (4, None)], "id long, name string")
    redirects = spark.createDataFrame([("hsr", "honkai:_star_rail")], "antecedent_name string, consequent_name string")
    index = spark.createDataFrame([("shinomiya_kaguya", "shinomiya_kaguya"), ("black_swan_(honkai:_star_rail)", "black_swan_(honkai:_star_rail)")], "key string, canonical string")
    got = {r["id"]: (r["tag"], r["strategy"]) for r in resolve.cascade(names, resolve.keys(names, redirects), [lambda k: resolve.by_dictionary(k, index)]).collect()}
    assert got == {1: ("shinomiya kaguya", "csv:inverted"), 2: ("black swan (honkai: star rail)", "csv:series_alias"), 3: ("", "not_found"), 4: ("", "not_found")}
    tags = spark.createDataFrame([("black_swan_(ff)", 900), ("black_swan_(hsr)", 5)], "tag string, post_count long")
    both = tags.select(F.col("tag").alias("key"), F.col("tag").alias("canonical"))
    assert [r["tag"] for r in resolve.by_tag_search(names, resolve.keys(names, redirects), tags, both).collect()] == ["black swan (hsr)"]


def test_cards(spark):
    html = """<div class="card"><div class="card-header"><span> Miku </span></div><img alt="thumbnail" src="/p/a.jpg"><div class="card-body"><div class="alert alert-secondary">miku, vocaloid,
      1girl</div></div></div><div class="card"><div>no header</div></div><div class="card wide"><div class="card-header">  </div></div>
      <div class="card"><div class="card-header">Ab</div><img alt="thumbnail" src="http://x/y.png"><div class="alert-secondary">long hair, five words are too many, ok one</div></div>"""
    df = spark.createDataFrame([(2, html), (3, None)], "page long, html string")
    got = sorted(tuple(r) for r in cards.extract_cards(df, "https://base/").collect())
    assert got == [("Ab", "ok one", "long hair, five words are too many, ok one", "http://x/y.png", 28), ("Miku", "vocaloid", "miku, vocaloid, 1girl", "https://base/p/a.jpg", 25)]


def log(spark, data):
    start = dt.datetime(2024, 1, 1)
    rows = [(a, u, start + dt.timedelta(minutes=a), start + dt.timedelta(minutes=a), act, c, t) for a, u, act, c, t in data]
    return spark.createDataFrame(rows, "action_id long, user_id long, ts timestamp, received_at timestamp, act string, char_id long, typed string")


def test_state(spark):
    actions = log(spark, [(1, 1, "search", None, "a"), (2, 1, "search", None, "b"), (3, 1, "search", None, "a "), (3, 1, "search", None, "a "), (4, 1, "search", None, " "), *[(10 + i, 2, "search", None, f"q{i}") for i in range(21)], (50, 1, "favorite", 5, None), (51, 1, "favorite", 5, None), (52, 1, "favorite", 7, None), (52, 1, "favorite", 7, None), (60, 1, "override", 3, "x"), (61, 2, "override", 3, None)])
    history = {(r["user_id"], r["place"]): r["item"] for r in state.search_history(actions).collect()}
    assert [history[1, 1], history[1, 2]] == ["a", "b"] and (1, 3) not in history
    assert history[2, 1] == "q20" and (2, 21) not in history and len(history) == 22
    assert [tuple(r) for r in state.favorites(actions).collect()] == [(1, 7)]
    assert [tuple(r) for r in state.overrides(actions).collect()] == [(3, None)]
    assert [r["value"] for r in writers.favorites_json(state.favorites(actions)).collect()] == ["[7]"]


def test_cache(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", start + dt.timedelta(seconds=s)) for s in (0, 1000, 1700, 1900, 3600)] + [("o", start), (None, start)], "key string, at timestamp")
    got = sorted((r["key"], r["at"], r["hit"]) for r in state.cache_use(df, "key", "at").collect())
    assert [h for _, _, h in got] == [False, True, True, False, True, False]


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text('Tag , category,post_count,aliases\nblazer,0,5,"a,b"\nbad,x,7,\n', encoding="utf-8")
    got = {r["tag"]: (r["category"], r["post_count"], r["aliases"]) for r in readers.read_dictionary(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {"blazer": (0, 5, ["a", "b"]), "bad": (0, 0, [])}
    df = spark.createDataFrame([('[1, "2", "x"]', '["a", " "]', '{"1": "t"}'), ("broken", "{", "[")], "f string, h string, o string")
    one, two = df.select(readers.parse_id_list("f").alias("f"), readers.parse_text_list("h").alias("h"), readers.parse_overrides("o").alias("o")).collect()
    assert (one["f"], one["h"], one["o"]) == ([1, 2], ["a"], {"1": "t"}) and (two["f"], two["h"]) == ([], [])
    rows = spark.createDataFrame([("A b!", " x, y "), ("z", " ")], "name string, tags string")
    writers.write_wildcards(rows, str(tmp_path / "w"))
    assert {f.name: f.read_text() for f in (tmp_path / "w").iterdir()} == {"a_b.txt": "x, y\n"}
    cat = spark.createDataFrame([(1, "n", None, "t", None, 1, None, "a")], CATALOG)
    writers.write_catalog(cat, str(tmp_path / "c"))
    writers.append_catalog(cat.select("id", "name", "tags"), str(tmp_path / "old"))
    assert readers.read_catalog(spark, str(tmp_path / "old")).select("source", "danbooru_tag").first()[:] == ("danbooru", None)
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "page_7.html").write_text("<p>x</p>")
    assert readers.read_pages(spark, str(tmp_path / "pages")).first()[:] == (7, "<p>x</p>")


def test_written_tables_can_be_dropped(spark):
    from tagsieve.session import cut_lineage, drop_written, written

    drop_written(spark)
    df = written(spark.range(5))
    assert df.count() == 5 and cut_lineage(df).count() == 5
    assert drop_written(spark) == 1 and drop_written(spark) == 0
