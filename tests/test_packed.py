"""Splitting of packed values: cases by hand, a second implementation, round trips."""

import random

import pytest

from tagsieve.operators.packed import delimiter_profile, either, explode_packed, known_pattern, shaped_pattern, source_scores, with_packed_values

KNOWN = known_pattern(["hush;_listen", "bread,_butter", "|_|", ";)", ":|", "sun|moon_motif", "plain_tag"])


def split(spark, texts, known=KNOWN):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = {r["id"]: r["vals"] for r in with_packed_values(df, "text", "vals", known).collect()}
    return [rows[i] for i in range(len(texts))]


CASES = [
    ("a b, c d, e", ["a b", "c d", "e"]),
    ("a b;c d;e", ["a b", "c d", "e"]),
    ("a | b | c", ["a", "b", "c"]),
    ("a\nb c\nd", ["a", "b c", "d"]),
    ("a\tb\tc", ["a", "b", "c"]),
    ("甲、乙、丙", ["甲", "乙", "丙"]),
    ("a，b，c", ["a", "b", "c"]),
    ("a / b / :/", ["a", "b", ":/"]),
    ("blue_hair red_eyes solo", ["blue_hair", "red_eyes", "solo"]),
    ("blue hair", ["blue hair"]),
    ("a, b;c | d\ne , f", ["a", "b", "c", "d", "e", "f"]),
    ("a b, hush; listen, c d, e f, g h", ["a b", "hush; listen", "c d", "e f", "g h"]),
    ("x y, bread, butter, z", ["x y", "bread, butter", "z"]),
    ("one two, sun; moon, three four, five six, seven, eight", ["one two", "sun", "moon", "three four", "five six", "seven", "eight"]),
    ("jade_bell,_leaning_zeshavi ナクス", ["jade_bell,_leaning_zeshavi", "ナクス"]),
    ('"blue_hair" "red_eyes"', ["blue_hair", "red_eyes"]),
    ('"a, b", c, \'d, e\', “f, g”', ["a, b", "c", "d, e", "f, g"]),
    ('"so-called ""hero""", b, c', ['so-called "hero"', "b", "c"]),
    ('so-called "hero", b, c', ['so-called "hero"', "b", "c"]),
    ("a, , b,, c,", ["a", "b", "c"]),
    ("jade_bell,_leaning_zeshavi", ["jade_bell,_leaning_zeshavi"]),
    ("a_b; jade_bell,_leaning_z", ["a_b", "jade_bell,_leaning_z"]),
    ("yes;_no;_maybe red_eyes", ["yes;_no;_maybe", "red_eyes"]),
    ("face x_x", ["face x_x"]),
    ("a, |_|, ;), b", ["a", "|_|", ";)", "b"]),
    ("2b \\(nier\\), A_b, a_B", ["2b \\(nier\\)", "A_b", "a_B"]),
    ("a, b, mint hor…", ["a", "b", "mint hor…"]),
    ('a, b, "mint hor', ["a", "b", '"mint hor']),
    ("a, a, a", ["a", "a", "a"]),
    (None, []),
    ("", []),
    (" \n\t ", []),
    (", ;", []),
]


@pytest.mark.parametrize("k", [0])
def test_cases(spark, k):
    got = split(spark, [c[0] for c in CASES])
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[1]) for c in CASES]


def test_regular_record_without_a_list_of_known_values(spark):
    text = "one two, sun; moon, three four, five six, seven, eight"
    assert split(spark, [text, "a, b;c,d , e;f"], None) == [["one two", "sun; moon", "three four", "five six", "seven", "eight"], ["a", "b", "c", "d", "e", "f"]]


def test_very_long_text(spark):
    values = [f"value {i}" for i in range(60_000)]
    long_piece = "x" * 1_000_000
    got = split(spark, [", ".join(values), f"{long_piece};{long_piece}", '"' + "a, " * 200_000 + '", b, c'])
    assert got[0] == values
    assert [len(v) for v in got[1]] == [1_000_000, 1_000_000]
    assert got[2][1:] == ["b", "c"]


def test_round_trip(spark):
    """Lists written with one delimiter, quoted where a value holds it, come back as they were."""
    rng = random.Random(5)
    values = ["blue hair", "red eyes", "waist-length plait", "wait, what", "left; right", "rise | fall", "o_o", "long ears", "6+girls", "side (pose)"]
    texts, wanted = [], []
    for _ in range(200):
        row = [rng.choice(values) for _ in range(rng.randint(6, 15))]
        delimiter = rng.choice([", ", ",", ";", "; ", "|", " | ", "\n", "\t", "、", "，", " / "])
        mark = delimiter.strip() or delimiter
        texts.append(delimiter.join(f'"{v}"' if mark in v else v for v in row))
        wanted.append(row)
    known = known_pattern(["wait,_what", "left;_right", "rise_|_fall"])
    assert split(spark, texts, known) == wanted


def test_explode_keeps_repeated_rows_and_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (1, "a, b", "y"), (2, None, "z")], "id long, tags string, vals string")
    rows = sorted(tuple(r) for r in explode_packed(df, "id", "tags").collect())
    assert rows == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]


def test_profile_of_sources(spark):
    df = spark.createDataFrame([("s", "a, b, c"), ("s", "a, b"), ("s", "x;y"), ("t", "aa_b cc_d"), (None, "one"), ("t", None), ("t", " ")], "source string, tags string")
    got = {(r["source"], r["kind"]): (r["records"], round(r["share"], 3), r["mean_pieces"], round(r["spread"], 3)) for r in delimiter_profile(df, "source", "tags").collect()}
    assert got == {("s", "comma"): (2, 0.667, 2.5, 0.2), ("s", "semicolon"): (1, 0.333, 2.0, 0.0), ("t", "blank"): (1, 1.0, 2.0, 0.0), (None, "none"): (1, 1.0, 1.0, 0.0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, tags string")
    assert explode_packed(df, "id", "tags").collect() == []


def test_shapes_are_learnt_from_many_alike():
    values = [f"{a}_{b},_{c}ing_name{i}" for i, (a, b, c) in enumerate((a, b, c) for a in ("jade", "bone", "ash") for b in ("bell", "fan", "staff") for c in ("wav", "bow", "doz"))]
    pattern = shaped_pattern(values)
    assert pattern is not None and either(None, pattern) is not None
    assert shaped_pattern(values[:5]) is None
    import regex

    assert regex.fullmatch(pattern.replace("(?iu:", "(?i:"), "bone fan, waving other")
    assert not regex.fullmatch(pattern.replace("(?iu:", "(?i:"), "bone fan, other name")


def test_values_behind_many_blanks(spark):
    known = known_pattern(["red, blue"])
    for n in (1, 9, 10, 40):
        gap = " " * n
        rows = [(1, f'a,{gap}"b, c",{gap}d, e'), (2, f"a,{gap}red, blue,{gap}d, e"), (3, f"a; x;{gap}'b; c'; d")]
        df = spark.createDataFrame(rows, "id long, text string")
        got = {r["id"]: r["vals"] for r in with_packed_values(df, "text", "vals", known).collect()}
        assert got == {1: ["a", "b, c", "d", "e"], 2: ["a", "red, blue", "d", "e"], 3: ["a", "x", "b; c", "d"]}
    assert split(spark, ["smile;) ; b; c"]) == split(spark, ["smile; ) ; b; c"])


def test_marks_used_equally_often_are_told_apart_by_the_source(spark):
    rows = [(k, "a", f"甲{k}; 乙{k}; 丙") for k in range(20)] + [(100 + k, "b", f"甲{k}、乙{k}、丙") for k in range(20)]
    rows += [(200, "a", "甲、乙;丙"), (201, "b", "甲、乙;丙"), (202, None, "甲、乙;丙")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r["id"]: r["vals"] for r in with_packed_values(df, "text", "vals", KNOWN, source_col="source").collect()}
    assert got[200] == ["甲、乙", "丙"] and got[201] == ["甲", "乙;丙"] and len(got[202]) == 2
    assert got[0] == ["甲0", "乙0", "丙"] and got[100] == ["甲0", "乙0", "丙"] and len(got) == len(rows)
    scores = {r["_scored"]: r for r in source_scores(df, "source", "text").collect()}
    assert scores["a"]["_s_semicolon"] > scores["a"]["_s_ideographic"] and scores["b"]["_s_ideographic"] > scores["b"]["_s_semicolon"]


def test_stand_ins_in_the_data_stay(spark):
    assert split(spark, ["a\x01b, c", "a\x02b / c\x01 / \x02a", "x\x02, \"y\x01, z\""]) == [["a\x01b", "c"], ["a\x02b", "c\x01", "\x02a"], ["x\x02", "y\x01, z"]]


def test_hints_miss_no_known_value(spark):
    """Every known value is found wherever it stands, written with blanks or underscores and in any case."""
    values = ["hush;_listen", "bread,_butter", "|_|", ";)", ":|", "sun|moon_motif", "\\m/", "one,_two,_three", "|d"]
    known = known_pattern(values)
    texts = [t for v in values for w in (v, v.replace("_", " "), v.upper()) for t in (f"{w}, x y, z", f"x y, {w}, z", f"x y\t{w}", f"x y、{w}")]
    for vals, v in zip(split(spark, texts, known), [v for v in values for _ in range(12)]):
        assert v.lower().replace("_", " ") in [x.lower().replace("_", " ") for x in vals]
