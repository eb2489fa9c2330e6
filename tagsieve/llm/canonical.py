"""Freely typed values mapped to a canonical list.

A multi-pattern automaton over the canonical names, their forms without the bracketed series and their aliases finds
mentions in a value; the longest non-overlapping mention wins if what is left over says nothing else: decoration, or the
name of a series. Values without one go to token-set similarity: their words in any order, with and without blanks
between them, are compared with all names: as token sets, through an index of the names' words of which the rarest of a
value are looked up, and as joined texts, through an index of removals that a value with few edits must share with the
name. Edits (insertion, deletion, exchange, swap of neighbours) count inside words; one word in five may be missing or
added. A name that exists in several series is decided by the record's own series, then by the series in the value,
then by frequency.

The canonical list is a dictionary of fixed size; its bound is checked before it is sent to the executors.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the canonical list and its aliases that are sent to the executors.
MOST_ENTRIES = 2_000_000
#: Edits allowed by length of the shorter text (without blanks).
EDITS = ((8, 2), (5, 1))
#: Characters of a text that enter the index of removals.
PREFIX = 12
#: Words in common, over all words of both sides, of token sets that are alike; an unpaired word counts as so many edits.
SHARED, UNPAIRED = 0.8, 3
#: Words around a name that say nothing about it.
DECORATION = frozenset(
    "the a an of from as in by and official art fan fanart cosplay original character commission oc alt alternate version ver anime game series manga novel"
    " franchise film movie lady lord sir miss mister mr mrs ms dr saint chan kun san sama senpai sensei tan dono new old young v1 v2 v3 wip sketch portrait".split()
)
_WORDS = re.compile(r"[^\W_]+")
_ZERO = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SUFFIX = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*$")
_MEMO = 200_000


def fold(value: str) -> str:
    """Compatibility form, lower case, no accents on Latin letters, hiragana as katakana, no zero-width characters."""
    text = unicodedata.normalize("NFKC", value.translate(_ZERO)).casefold().replace("\\", "").replace("_", " ")
    out: list[str] = []
    for c in unicodedata.normalize("NFD", text):
        if "̀" <= c <= "ͯ" and out and out[-1] < "Ͱ":
            continue
        out.append(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c)
    return unicodedata.normalize("NFC", "".join(out)).replace("・", " ")


def words(value: str) -> list[str]:
    return _WORDS.findall(fold(value))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Equal ends cost nothing.
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    end = 0
    while end < n - k and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[k : len(a) - end], b[k : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def most_edits(n: int) -> int:
    return next((e for least, e in EDITS if n >= least), 0)


def _deletions(text: str, most: int = 2) -> list[int]:
    """Hashes of the first PREFIX characters with up to ``most`` (one or two) of them removed; valid within one process.

    Two texts within so many edits have one of these in common.
    """
    head = text[:PREFIX]
    once = {head[:i] + head[i + 1 :] for i in range(len(head))}
    twice = {one[:j] + one[j + 1 :] for one in once for j in range(len(one))} if most > 1 else set()
    return list(map(hash, {head} | once | twice))


class Names:
    """One category of the canonical list: exact forms, automaton and similarity index."""

    def __init__(self, entries: list[tuple[str, str, str, int]]) -> None:
        """``entries``: (tag, form, series of the form or '', frequency); several forms a tag, several tags a form."""
        import ahocorasick  # here, so that the other operators of the package work without it

        self.forms: dict[tuple[str, ...], dict[str, tuple[str, int]]] = defaultdict(dict)
        for tag, form, series, count in entries:
            key = tuple(words(form))
            if key:
                self.forms[key][tag] = (series, count)
        self.automaton = ahocorasick.Automaton()
        for key in self.forms:
            self.automaton.add_word(" " + " ".join(key) + " ", key)
        if self.forms:
            self.automaton.make_automaton()
        self.joined: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for key in self.forms:
            self.joined["".join(key)].add(key)
        self.texts = sorted(self.joined)
        hashes, owners = [], []
        for k, text in enumerate(self.texts):
            for h in _deletions(text):
                hashes.append(h)
                owners.append(k)
        order = np.argsort(np.array(hashes, dtype=np.int64), kind="stable")
        # Two words have two orders, which the joined texts cover; token sets are of three words or more.
        self.sets = [key for key in sorted(self.forms) if len(key) > 2]
        self.with_word: dict[str, list[int]] = defaultdict(list)
        for k, key in enumerate(self.sets):
            for w in set(key):
                self.with_word[w].append(k)
        self.hashes, self.starts = np.unique(np.array(hashes, dtype=np.int64)[order], return_index=True)
        self.owners = np.array(owners, dtype=np.int32)[order]
        self.starts = np.append(self.starts, len(self.owners))

    def mentions(self, tokens: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
        """Longest non-overlapping mentions (first word, end word, form), longest first."""
        if not self.forms or not tokens:
            return []
        text = " " + " ".join(tokens) + " "
        place = {}
        at = 0
        for k, t in enumerate(tokens):
            place[at] = k
            at += len(t) + 1
        found = []
        for end, key in self.automaton.iter(text):
            start = end - len(" ".join(key)) - 1
            found.append((len(" ".join(key)), place[start], place[start] + len(key), key))
        out: list[tuple[int, int, tuple[str, ...]]] = []
        for _, a, b, key in sorted(found, key=lambda f: (-f[0], f[1])):
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, key))
        return out

    def similar(self, tokens: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        """(edits, form) of the nearest forms by token-set similarity; all ties."""
        if not tokens:
            return []
        orders = {"".join(tokens), "".join(sorted(tokens)), "".join(tokens[1:] + tokens[:1]), "".join(tokens[-1:] + tokens[:-1])}
        best, out = 99, []
        for text in sorted(orders):
            n = len(text)
            wanted = np.array(_deletions(text, max(1, most_edits(n))), dtype=np.int64)
            at = np.searchsorted(self.hashes, wanted)
            at[at == len(self.hashes)] = 0
            met = at[self.hashes[at] == wanted].tolist() if len(self.hashes) else ()
            candidates = {self.texts[k] for p in met for k in self.owners[self.starts[p] : self.starts[p + 1]].tolist()}
            for other in candidates:
                d = edits(text, other, min(best, most_edits(min(n, len(other)))))
                if d <= min(best, most_edits(min(n, len(other)))):
                    if d < best:
                        best, out = d, []
                    out += [(d, key) for key in sorted(self.joined[other])]
        for d, key in self._alike(tokens, best):
            if d < best:
                best, out = d, []
            if d == best:
                out.append((d, key))
        return sorted(set(out))

    def _alike(self, tokens: list[str], most: int) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(edits, form) of forms with the same set of words, but for the edits that the length allows and unpaired words.

        All but ``changed`` words of the value stand in such a form as they are, so every form has one of any
        ``changed`` + 1 words of the value: the rarest ones are looked up. What is left of both sides is paired in the
        cheapest way.
        """
        if len(tokens) < 3:
            return
        mine, n = Counter(tokens), sum(map(len, tokens))
        changed = most_edits(n) + int(len(tokens) * (1 - SHARED) / SHARED)
        rarest = sorted(mine, key=lambda w: (len(self.with_word.get(w, ())), w))[: changed + 1]
        for k in sorted({k for w in rarest for k in self.with_word.get(w, ())}):
            key = self.sets[k]
            longer = max(len(tokens), len(key))
            if abs(len(key) - len(tokens)) > (1 - SHARED) * longer + 1e-9 or longer - len(mine.keys() & set(key)) > longer - len(mine) + changed:
                continue
            theirs = Counter(key)
            fewer, more = sorted((list((mine - theirs).elements()), list((theirs - mine).elements())), key=len)
            unpaired = len(more) - len(fewer)
            allowed = min(most - UNPAIRED * unpaired, most_edits(min(n, sum(map(len, key)))))
            if len(fewer) > allowed:
                continue
            d = min(sum(edits(a, b, allowed) for a, b in zip(fewer, p)) for p in itertools.permutations(more, len(fewer)))
            if d <= allowed:
                yield d + UNPAIRED * unpaired, key


class Matcher:
    """Maps names and series; knows which series a name belongs to."""

    def __init__(self, entries: list[tuple[str, int, str, int]]) -> None:
        """``entries``: (tag, category, form, frequency) with category 3 for series and 4 for characters."""
        series = [(tag, form, "", count) for tag, category, form, count in entries if category == 3]
        self.series = Names(series)
        names = []
        for tag, category, form, count in entries:
            if category != 4:
                continue
            own = _SUFFIX.search(fold(tag))
            belongs = own.group(1) if own else ""
            belongs_tag = self.series_of(belongs) if belongs else ""
            names.append((tag, form, belongs_tag, count))
            inner = _SUFFIX.search(fold(form))
            if inner and self.series_of(inner.group(1)):
                names.append((tag, fold(form)[: inner.start()], belongs_tag, count))
        self.names = Names(names)
        self.series_words = {w for key in self.series.forms for w in key}
        self.memo: dict[tuple[str, str], str] = {}

    def series_of(self, value: str | None) -> str:
        """The series a value stands for, or ''."""
        tokens = words(value or "")
        for candidate in (tokens, [t for t in tokens if t not in DECORATION]):
            if tuple(candidate) in self.series.forms:
                return self._frequent(self.series.forms[tuple(candidate)])
        for a, b, key in self.series.mentions(tokens)[:1]:
            if all(t in DECORATION for t in tokens[:a] + tokens[b:]):
                return self._frequent(self.series.forms[key])
        kept = [t for t in tokens if t not in DECORATION] or tokens
        for candidate in (kept, tokens) if kept != tokens else (kept,):
            found = self.series.similar(candidate)
            if found:
                return self._frequent({t: c for _, key in found for t, c in self.series.forms[key].items()})
        return ""

    @staticmethod
    def _frequent(tags: dict[str, tuple[str, int]]) -> str:
        return min(tags, key=lambda t: (-tags[t][1], t)) if tags else ""

    def _choose(self, tags: dict[str, tuple[str, int]], row_series: str, own_series: str) -> str:
        for wanted in (row_series, own_series):
            fitting = {t: v for t, v in tags.items() if wanted and v[0] == wanted}
            if fitting:
                return self._frequent(fitting)
        return self._frequent(tags)

    def name_of(self, value: str | None, series: str | None) -> str:
        """The character a value stands for, or ''; ``series`` is the record's own."""
        return self._name_of(value or "", self.cached_series(series))

    def cached_series(self, series: str | None) -> str:
        key = ("series", series or "")
        if key not in self.memo:
            self.memo[key] = self.series_of(series)
        return self.memo[key]

    def _name_of(self, value: str, row_series: str) -> str:
        tokens = words(value)
        if not tokens:
            return ""
        if tuple(tokens) in self.names.forms:
            return self._choose(self.names.forms[tuple(tokens)], row_series, "")
        # Cut the value where something other than the name may start: brackets, spaced dashes, slashes, "from".
        text = fold(value).strip()
        head = re.split(r"\s*[(\[【（{]|\s+[-–—/|]\s+|\s+from\s+", text.strip(" \"'“”‘’«»★☆*~"), maxsplit=1)
        name_words = words(head[0])
        rest = text[len(head[0]) :] if len(head) > 1 else ""
        own_series = self.series_of(rest) if words(rest) else ""
        for a, b, key in self.names.mentions(tokens)[:1]:
            left = tokens[:a] + tokens[b:]
            free = [t for t in left if t not in DECORATION]
            if not free or self._is_series(free):
                return self._choose(self.names.forms[key], row_series, own_series or self.series_of(" ".join(free)))
        kept = [t for t in name_words if t not in DECORATION] or name_words
        tries = dict.fromkeys(map(tuple, (kept, name_words, [t for t in tokens if t not in DECORATION])))
        found: list[tuple[int, tuple[str, ...]]] = []
        for attempt in tries:
            near = self.names.similar(list(attempt))
            if near and (not found or near[0][0] < found[0][0]):
                found = near
        # The name may be followed by its series without any mark between.
        if not found:
            for a, b, key in self.series.mentions(tokens)[:1]:
                found = self.names.similar(tokens[:a] + tokens[b:])
                own_series = own_series or self._frequent(self.series.forms[key])
        if not found:
            return ""
        tags = {t: c for _, key in found for t, c in self.names.forms[key].items()}
        return self._choose(tags, row_series, own_series)

    def _is_series(self, tokens: list[str]) -> bool:
        return all(t in self.series_words for t in tokens) or bool(self.series.similar(tokens))

    def resolve(self, field: str, value: str, series: str | None) -> str:
        """Canonical tag of a value of one of the three fields, or ''."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        if field == "series":
            return self.cached_series(value)
        key = (value, self.cached_series(series))
        if key not in self.memo:
            self.memo[key] = self._name_of(*key)
        return self.memo[key]


def canonical_entries(tags: DataFrame, aliases: DataFrame, redirects: DataFrame) -> list[tuple[str, int, str, int]]:
    """(tag, category, form, frequency) of the categories 3 and 4.

    ``tags``: tag, category, post_count, line_no; ``aliases``: tag, alias; ``redirects``: antecedent_name,
    consequent_name, followed through chains to a listed tag and dropped where they end elsewhere or in a circle. Of
    several targets of one name the first by its letters is taken, of several tags of one alias the most frequent.
    """
    listed = tags.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.max_by("category", F.coalesce("post_count", F.lit(-1))).alias("category"), F.max(F.coalesce("post_count", F.lit(0))).alias("count"))
    rows = listed.limit(MOST_ENTRIES + 1).collect()
    names = aliases.distinct().limit(MOST_ENTRIES + 1).collect()
    moved = redirects.distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) + len(names) + len(moved) > MOST_ENTRIES:
        raise ValueError(f"the canonical list has more than {MOST_ENTRIES} entries")
    kind = {r["tag"]: (r["category"], r["count"]) for r in rows}
    out = [(tag, c, tag, n) for tag, (c, n) in kind.items()]
    out += [(r["tag"], *_form(kind[r["tag"]], r["alias"])) for r in names if r["tag"] in kind and r["alias"]]
    to: dict[str, str] = {}
    for source, target in sorted(((r["antecedent_name"], r["consequent_name"]) for r in moved if r["antecedent_name"] and r["consequent_name"]), reverse=True):
        to[source] = target
    by_alias: dict[str, str] = {}
    for tag, alias in sorted(((r["tag"], r["alias"]) for r in names if r["alias"] and r["tag"] in kind), key=lambda x: (kind[x[0]][1], x), reverse=True):
        by_alias.setdefault(alias.replace(" ", "_"), tag)
    for start in to:
        at, seen = start, set()
        while at not in kind and at not in seen:
            seen.add(at)
            at = to.get(at) or by_alias.get(at) or ""
        if at in kind and start not in kind:
            out.append((at, *_form(kind[at], start)))
    return sorted({e for e in out if e[1] in (3, 4)})


def _form(kind: tuple[int, int], form: str) -> tuple[int, str, int]:
    return kind[0], form, kind[1]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(token: str, entries: list[tuple[str, int, str, int]]) -> Matcher:
    """The matcher of this worker process; the tasks of a query share it."""
    if token not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[token] = Matcher(entries)
    return _MATCHERS[token]


def map_values(df: DataFrame, id_col: str, fields: list[str], series_col: str, entries: list[tuple[str, int, str, int]], with_value: bool = False) -> DataFrame:
    """(id, field, tag) for each non-NULL, non-blank value of ``fields``; tag is '' where the list holds none. A further
    column ``value`` has the value as typed, if wanted.

    The field named ``series_col`` maps to series, the others to characters of that series. Repeated rows give repeated
    results; an empty list gives '' everywhere. Extra columns are not carried.
    """
    shared = df.sparkSession.sparkContext.broadcast(entries)

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(token, shared.value)
        for batch in batches:
            series = batch.column("_series").to_pylist()
            rows, names, tags, typed = [], [], [], []
            for k, field in enumerate(fields):
                for row, (value, own) in enumerate(zip(batch.column(f"_v{k}").to_pylist(), series)):
                    if value is not None and value.strip():
                        rows.append(row)
                        names.append(field)
                        tags.append(matcher.resolve("series" if field == series_col else "name", value, own))
                        typed.append(value)
            out = {"_id": batch.column("_id").take(pa.array(rows, pa.int32())), "field": pa.array(names, pa.string()), "tag": pa.array(tags, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"value": pa.array(typed, pa.string())} if with_value else {}))

    kind = df.schema[id_col].dataType.simpleString()
    values = [F.col(f"`{f}`").alias(f"_v{k}") for k, f in enumerate(fields)]
    ready = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{series_col}`").alias("_series"), *values)
    return ready.mapInArrow(run, f"_id {kind}, field string, tag string" + ", value string" * with_value).withColumnRenamed("_id", id_col)
