"""Several values packed in one field: infer the delimiter, split, explode with position.

For every source the candidate delimiters are scored over all its texts: how many texts hold them, how consistent the
piece counts are, and how regular the pieces (free of other candidates). A record is then cut by the candidate that
leaves its pieces regular outside quotes and known values; candidates that do so equally are told apart by the score in
the source. Where several marks separate in one record no candidate leaves regular pieces, and it is cut at all of
them. One delimiter for a source, without the look at the record, would be wrong where records of a source differ.

Everything is built from JVM expressions; no row passes through Python and no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.functions.text import BLANKS, blank, strip
from tagsieve.session import written

#: Marks that can separate values, by the name of the kind. " / " separates only between blanks.
SINGLE = {"comma": ",", "semicolon": ";", "bar": "|", "line": "\n", "tab": "\t", "ideographic": "、", "fullwidth": "，", "slash": "\x01"}
#: Marks that occur together in records without one delimiter.
MIXING = ("comma", "semicolon", "bar", "line")
#: More known values than this are not compiled into one pattern.
MOST_KNOWN = 20_000

_MARKS = ",;|\n\t、，/\x01"
_INSIDE = "".join("\\" + c if c in "|/" else c for c in _MARKS)
_CLASS = f"[{_INSIDE}]"
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Possessive and without a group for each character: the engine recurses on such groups, and texts may be long.
_QUOTED = r"""(?:"[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'|“[^”]*+”)"""
_OPEN = r"""(?:"[^"]*+|'[^']*+|“[^”]*+)$"""
#: A value stands between marks, blanks or the ends of the text.
_BEFORE = rf"(?<![^{_INSIDE}\s])"
_AFTER = rf"(?![^{_INSIDE}\s])"
#: Words joined by an underscore: blanks of such a text are free to separate values.
_JOINED = r"[^\W_]{2}_|_[^\W_]{2}"


class Known(str):
    """A pattern of known values with ``hint``, a pattern that every text with such a value matches, tested first."""

    hint: str | None = None

    def __new__(cls, pattern: str, hint: str | None = None) -> Known:
        made = super().__new__(cls, pattern)
        made.hint = hint
        return made


def java_quote(text: str) -> str:
    """A literal for java.util.regex."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&~#" else c for c in text)


def known_pattern(values: list[str]) -> str | None:
    """A pattern of the values that contain a separating mark, with blanks and underscores as equals."""
    kept = {re.sub(r"[_\s]+", " ", v.strip()).lower() for v in values if re.search(_CLASS, v)}
    if len(kept) > MOST_KNOWN:
        raise ValueError(f"{len(kept)} known values with separating marks; at most {MOST_KNOWN} are supported")
    return Known(f"(?iu:{_trie_pattern(sorted(kept))})", _hint(kept)) if kept else None


def _hint(values: set[str]) -> str:
    """A pattern of what follows the first mark in each value; where that is short, with the letter in front of the mark."""
    parts: dict[str, set[str]] = {}
    for v in values:
        at = re.search(_CLASS, v).start()
        parts.setdefault(v[at - 1 : at] if len(v) - at < 4 else "", set()).add(v[at:])
    sides = [(f"(?<={java_quote(c)})" if c else "") + _trie_pattern(sorted(rest)) for c, rest in sorted(parts.items())]
    return f"(?={_CLASS})(?iu:{'|'.join(sides)}){_AFTER}"


def _trie_pattern(values: list[str]) -> str:
    """A pattern of sorted values that branches once a character, so that a place is left after one comparison a branch."""
    branches: dict[str, list[str]] = {}
    for v in values:
        if v:
            branches.setdefault(v[0], []).append(v[1:])
    out = []
    for first, rest in branches.items():
        if len(rest) == 1:
            first, rest = first + rest[0], [""]
        out.append(java_quote(first).replace(" ", "[_ ]") + _trie_pattern(rest))
    if not out:
        return ""
    return f"(?:{'|'.join(out)}){'?' if '' in values else ''}"


def shaped_pattern(values: list[str], least: int = 20) -> str | None:
    """A pattern of values shaped like many known ones: the same mark between as many words, and words known to stand first
    on either side. Only shapes of at least ``least`` known values whose first words repeat count as regular."""
    shapes: dict[tuple[str, int, int], list[tuple[str, str]]] = {}
    for v in {re.sub(r"[_\s]+", " ", v.strip()).lower() for v in values}:
        halves = re.split(r"([,;|] )", v)
        if len(halves) == 3 and halves[0].strip() and halves[2].strip():
            left, right = halves[0].split(), halves[2].split()
            shapes.setdefault((halves[1], len(left), len(right)), []).append((left[0], right[0]))
    found = []
    for (mark, n, m), firsts in sorted(shapes.items()):
        left, right = sorted({a for a, _ in firsts}), sorted({b for _, b in firsts})
        if len(firsts) >= least and 2 * max(len(left), len(right)) <= len(firsts):
            sides = [f"(?:{'|'.join(map(java_quote, ws))})(?:[_ ][\\p{{L}}-]+){{{k - 1}}}" for ws, k in ((left, n), (right, m))]
            found.append(sides[0] + java_quote(mark[0]) + "[_ ]" + sides[1])
    return Known("(?iu:" + "|".join(found) + ")") if found else None


def either(*patterns: str | None) -> str | None:
    """One pattern of several, leaving out those that are None."""
    kept = [p for p in patterns if p]
    hints = [getattr(p, "hint", None) for p in kept]
    return Known(f"(?:{'|'.join(kept)})", f"(?:{'|'.join(hints)})" if all(hints) else None) if kept else None


def known_values(*columns: DataFrame) -> list[str]:
    """Values with a separating mark from one-column frames of a dictionary; bounded by MOST_KNOWN."""
    found: list[str] = []
    for df in columns:
        name = df.columns[0]
        rows = df.where(F.col(f"`{name}`").rlike(_CLASS)).distinct().limit(MOST_KNOWN + 1).collect()
        found += [r[0] for r in rows]
    return found


def _without_quoted(text: Column) -> Column:
    """The text with quoted values as single letters; the pattern first looks for a quote."""
    return F.regexp_replace(text, rf"""(?=["'“]){_BEFORE}(?:{_QUOTED}{_AFTER}|{_OPEN})""", "q")


def _without_known(text: Column, known: str | None) -> Column:
    return F.regexp_replace(text, rf"{_BEFORE}{known}{_AFTER}", "k") if known else text


def _mark(c: str) -> str:
    """The mark as a separator: one that touches an underscore belongs to a value, as underscores stand for blanks inside values."""
    return rf"(?<!_){java_quote(c)}(?!_)"


def _count(text: Column, mark: str) -> Column:
    """Occurrences of the mark, by lengths in bytes."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark.encode())).cast("int")


def _score_columns(masked: Column, listed: bool) -> dict[str, Column]:
    """Counts of every mark outside quotes and known values; without a list also those with blanks beside the marks that mix."""
    out = {f"_n_{k}": _count(masked, c) for k, c in SINGLE.items()}
    for k in () if listed else MIXING:
        out[f"_after_{k}"] = _count(masked, SINGLE[k] + " ")
        out[f"_before_{k}"] = _count(masked, " " + SINGLE[k])
    return out


def _kind_from_scores(listed: bool, scored: bool) -> Column:
    """The kind by the columns of _score_columns: a key of SINGLE, 'mixed', 'blank' or 'none'.

    ``listed``: values that hold marks are known, so every mark that is left separates. Without a list one or two other
    marks in a record whose leading mark is regular are taken to stand inside values. Of marks that a record holds
    equally often the one with the highest score in its source (``scored``: the columns of source_scores) separates.
    """
    n = {k: F.col(f"_n_{k}") for k in SINGLE}
    top = F.greatest(*n.values())
    mixing = sum((n[k] > 0).cast("int") for k in MIXING)
    others = sum((n[k] > 0).cast("int") for k in SINGLE if k not in MIXING)
    minor = sum(n.values()) - top
    alike, single = F.lit(False), F.lit(None).cast("string")
    for k in reversed(list(SINGLE)):
        single = F.when((n[k] == top) & (top > 0), F.lit(k)).otherwise(single)
    if scored:
        best = F.greatest(*[F.when(n[k] == top, F.coalesce(F.col(f"_s_{k}"), F.lit(0.0))) for k in SINGLE])
        ranked = F.lit(None).cast("string")
        for k in reversed(list(SINGLE)):
            ranked = F.when((n[k] == top) & (F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)) == best), F.lit(k)).otherwise(ranked)
        single = F.when(minor >= top, ranked).otherwise(single)
    for k in () if listed else MIXING:
        after, before = F.col(f"_after_{k}"), F.col(f"_before_{k}")
        same = ((before == 0) & ((after <= 1) | (after >= n[k] - 1))) | ((before >= n[k] - 1) & (after >= n[k] - 1))
        alike = F.when((n[k] == top) & (top > 0), same).otherwise(alike)
    return (
        F.when(top == 0, F.when(F.col("_plain").rlike(r"\S\s+\S") & F.col("_whole").rlike(_JOINED), "blank").otherwise("none"))
        .when((mixing >= 2) & (others == 0) & (F.lit(listed) | ~(alike & (minor <= 2) & (top >= 4))), "mixed")
        .otherwise(single)
    )


def _inner(marks: str) -> str:
    """A piece without blanks around it: no separating mark, but marks that touch an underscore."""
    kept = rf"(?:(?<=_)[{marks}]|[{marks}](?=_))"
    return rf"(?:[^{marks}{_BLANK}]|{kept})[^{marks}]*(?:{kept}[^{marks}]*)*(?<![{_BLANK}])"


def _pieces(text: Column, kind: str, known: str | None) -> Column:
    """Pieces of the text, quotes still around them, blanks not."""
    if kind == "none":
        return F.array(text)
    if kind == "blank":
        marks, sep, inner = _BLANK, r"\s", r"\S++"
    else:
        marks = "".join(java_quote(SINGLE[k]) for k in (MIXING if kind == "mixed" else (kind,)))
        sep, inner = rf"(?<!_)[{marks}](?!_)", _inner(marks)
    # Any number of blanks behind a separator is read over, as a lookbehind is bounded. The first group is set there, the second is the piece.
    start, end = rf"(?:^|(?<=[{marks}]))[{_BLANK}]*+", rf"(?=[{_BLANK}]*(?:{sep}|$))"
    quoted = rf"""(?=["'“])(?:{_QUOTED}{end}|{_OPEN})"""
    listed = f"|{known}{end}" if known else ""
    whole = f"{quoted}{listed}"
    return F.regexp_extract_all(text, F.lit(rf"(?:{start}(?={whole})())?+(\1(?:{whole})|{inner})"), F.lit(2))


def _unquoted(v: Column) -> Column:
    inner = F.substring(v, F.lit(2), F.length(v) - 2)

    def around(a: str, b: str) -> Column:
        return (F.length(v) >= 2) & v.startswith(a) & v.endswith(b)

    return (
        F.when(around('"', '"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(around("'", "'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(around("“", "”"), inner)
        .otherwise(v)
    )


def _apart(c: Column) -> Column:
    """The same value, kept out of rewriting: the condition always holds, but is no pure function of the row, so the optimizer
    does not copy the expression into filters below, where its parts would multiply."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _stand_ins(text: Column) -> Column:
    """The stripped text with one character for " / ". Characters used as stand-ins are escaped where the data hold them."""
    escaped = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    free = F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), escaped).otherwise(text)
    return F.replace(strip(free), F.lit(" / "), F.lit("\x01"))


def _restored(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("\x01"), F.lit(" / ")), F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))


def _split(text: Column, kind: str) -> Column:
    """Pieces of a text without quotes, known values and marks that touch an underscore."""
    if kind == "none":
        return F.array(text)
    if kind == "blank":
        return F.split(text, rf"[{_BLANK}]++")
    chars = "".join(SINGLE[k] for k in (MIXING if kind == "mixed" else (kind,)))
    marks = "".join(map(java_quote, chars))

    def at(blanks: str) -> Column:
        beside = f"[{blanks}&&[^{marks}]]" if set(chars) & set(BLANKS) else f"[{blanks}]"
        # Ends are freed of separators first, so that no piece is empty.
        return F.split(F.btrim(text, F.lit(BLANKS + chars)), f"{beside}*+[{marks}][{marks}{blanks}]*+")

    # Texts of ASCII alone, told by their length in bytes, need the small class of blanks only.
    return F.when(F.octet_length(text) == F.length(text), at(r"\t-\r ")).otherwise(at(_BLANK))


def with_packed_values(df: DataFrame, text_col: str, out: str = "vals", known: str | None = None, kind_out: str | None = None, source_col: str | None = None) -> DataFrame:
    """Add the array of the values of a packed column, in order; ``kind_out`` names a column for the kind of delimiter.

    NULL and blank texts give an empty array. Pieces without content are dropped. Values are trimmed, quotes around them
    removed and doubled quotes inside made single; nothing else is changed and repeated values stay. The steps are
    columns of their own so that each is computed once. Most texts hold no quote, no known value and no mark beside an
    underscore: they are split at once, only the others go through the patterns. With ``source_col`` the candidates
    are scored for each source first, which reads the texts once more.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, kind_out)]
    staged = df.select(*kept, _stand_ins(F.col(f"`{text_col}`")).alias("_whole"))
    if source_col is not None:
        scores = written(source_scores(df, source_col, text_col))  # a table, so that its size is known when the join is planned
        staged = df.select(*kept, F.col(f"`{source_col}`").alias("_source"), _stand_ins(F.col(f"`{text_col}`")).alias("_whole")).join(scores, F.col("_source").eqNullSafe(F.col("_scored")), "left")
    whole = F.col("_whole")
    quoted = F.contains(whole, F.lit('"')) | F.contains(whole, F.lit("'")) | F.contains(whole, F.lit("“"))
    staged = staged.withColumn("_quoted", quoted).withColumn("_hinted", F.lit(False) if not known else whole.rlike(hint) if (hint := getattr(known, "hint", None)) else F.lit(True))
    staged = staged.withColumn("_touching", F.contains(whole, F.lit("_")) & whole.rlike(rf"_{_CLASS}|{_CLASS}_"))
    staged = staged.withColumn("_plain", F.when(F.col("_quoted"), _without_quoted(whole)).otherwise(whole))
    staged = staged.withColumn("_masked", F.when(F.col("_hinted"), _without_known(F.col("_plain"), known)).otherwise(F.col("_plain")))
    # Marks that touch an underscore are no marks.
    counted = F.when(F.col("_touching"), F.regexp_replace("_masked", rf"{_CLASS}?_{_CLASS}|{_CLASS}_", "k")).otherwise(F.col("_masked"))
    staged = staged.withColumn("_bare", _apart(counted))
    staged = staged.withColumns(_score_columns(F.col("_bare"), known is not None)).withColumn("_kind", _apart(_kind_from_scores(known is not None, source_col is not None)))
    pieces, simple = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for k in ["none", "blank", "mixed", *SINGLE]:
        pieces = F.when(F.col("_kind") == k, _pieces(whole, k, None)).otherwise(pieces)
        simple = F.when(F.col("_kind") == k, _split(whole, k)).otherwise(simple)
    if known:
        for k in ["blank", "mixed", *SINGLE]:
            pieces = F.when((F.col("_masked") != F.col("_plain")) & (F.col("_kind") == k), _pieces(whole, k, known)).otherwise(pieces)
    pieces = F.when(F.col("_quoted") | F.col("_hinted") | F.col("_touching"), pieces).otherwise(simple)
    if kind_out:
        staged = staged.withColumn(kind_out, F.when(whole != "", F.col("_kind")))
        kept.append(F.col(kind_out))
    rewritten = F.col("_quoted") | F.contains(whole, F.lit("\x01")) | F.contains(whole, F.lit("\x02"))
    staged = staged.select(*kept, rewritten.alias("_written"), _apart(pieces).alias("_pieces"))
    values = F.filter(F.transform("_pieces", lambda p: _restored(strip(_unquoted(p)))), lambda v: v != "")
    none = F.array().cast("array<string>")
    return staged.select(*kept, F.coalesce(F.when(F.col("_written") | (F.get("_pieces", 0) == ""), values).otherwise(F.col("_pieces")), none).alias(out))


def source_scores(df: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(_scored, _s_<kind>...): one row for each source with the score of every candidate delimiter in it.

    A candidate's score is the product of the share of the source's texts that hold it, the consistency of its piece
    counts, 1 / (1 + spread / mean), and the regularity of its pieces, the mean share of pieces in which no other
    candidate is left. All are sums over the texts, added up in each task first; marks are counted as written, as
    quoted and known values are rare.
    """
    text = df.select(F.col(f"`{source_col}`").alias("_scored"), _stand_ins(F.col(f"`{text_col}`")).alias("_t")).where(F.col("_t") != "")
    counts = text.select("_scored", *[_count(F.col("_t"), c).alias(k) for k, c in SINGLE.items()]).withColumn("_all", sum(F.col(k) for k in SINGLE))
    held = {k: F.col(k) > 0 for k in SINGLE}
    sums = [F.count(F.lit(1)).alias("_rows")]
    for k in SINGLE:
        size = F.when(held[k], (F.col(k) + 1).cast("double"))
        clean = F.greatest(F.lit(0.0), 1 - (F.col("_all") - F.col(k)) / (F.col(k) + 1))
        sums += [F.count(size).alias(f"_c_{k}"), F.avg(size).alias(f"_m_{k}"), F.stddev_pop(size).alias(f"_d_{k}"), F.avg(F.when(held[k], clean)).alias(f"_r_{k}")]
    grouped = counts.groupBy("_scored").agg(*sums)
    score = {k: F.coalesce(F.col(f"_c_{k}") / F.col("_rows") / (1 + F.col(f"_d_{k}") / F.col(f"_m_{k}")) * F.col(f"_r_{k}"), F.lit(0.0)) for k in SINGLE}
    return grouped.select("_scored", *[c.alias(f"_s_{k}") for k, c in score.items()])


def explode_packed(df: DataFrame, id_col: str, text_col: str, known: str | None = None, source_col: str | None = None) -> DataFrame:
    """One row (rec_id, pos, val) for each value of a packed column; ``pos`` counts from 0 within the record.

    ``source_col`` names the column whose values have their own scores of the candidate delimiters.

    Repeated input rows give repeated output rows. Other columns, whatever their names, are not carried.
    """
    own = [] if source_col is None else [F.col(f"`{source_col}`").alias("_from")]
    two = df.select(F.col(f"`{id_col}`").alias("rec_id"), F.col(f"`{text_col}`").alias("_text"), *own)
    values = with_packed_values(two, "_text", "vals", known, source_col="_from" if own else None)
    # The outer form keeps the optimizer from copying the whole expression of vals into an inferred filter below.
    return values.select("rec_id", F.posexplode_outer("vals").alias("pos", "val")).where(F.col("val").isNotNull())


def delimiter_profile(df: DataFrame, source_col: str, text_col: str, known: str | None = None) -> DataFrame:
    """(source, kind, records, share, mean_pieces, spread) for each source and kind of delimiter that its records use.

    ``spread`` is the standard deviation of the number of pieces over its mean, the consistency of a kind within a source.
    NULL and blank texts have no kind and are left out; a NULL source is a source of its own.
    """
    two = df.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("_text")).where(~blank("_text"))
    sized = with_packed_values(two, "_text", "vals", known, "kind", "source").select("source", "kind", F.size("vals").alias("n"))
    grouped = sized.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("records"), F.avg("n").alias("mean_pieces"), F.stddev_pop("n").alias("_sd"))
    totals = grouped.groupBy(F.col("source").alias("_s")).agg(F.sum("records").alias("_all"))
    joined = grouped.join(totals, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("source", "kind", "records", (F.col("records") / F.col("_all")).alias("share"), "mean_pieces", (F.col("_sd") / F.col("mean_pieces")).alias("spread"))
