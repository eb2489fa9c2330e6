"""Evaluation items leaking into training texts, whole or in part.

Texts are reduced to tokens: compatibility forms, lower case, no markup or punctuation; words, and single characters in
scripts without spaces. A leak is a passage of at least PASSAGE words (or characters) with at most about one in ten
changed, dropped or added.

Search. Items are partitioned by the size of their passages' shingle sets: windows of PASSAGE words hold 8 shingles of
five words, windows of 25 characters hold 20 shingles of six. The MinHash sketch of a window is its KEPT smallest
shingle hashes; an edit destroys at most as many shingles as a shingle has tokens, and KEPT leaves at least one of the
sketch in every passage that counts, so the search loses no leak. Long documents are met by containment: the sketch
hashes found among all shingles of the document are the hits. Sketches of a block of items are sent to the executors
and every document is read once per block; a block has at most BLOCK sketch hashes, so a larger item set means more
passes and never a larger broadcast. Nothing is shuffled.

Verification. For every hit pair the exact shingles shared by item and document are chained: runs on near diagonals
form a passage whose words and edits are counted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of a shingle, of the shortest passage, and sketch hashes kept of a window, for words and for characters.
SHINGLE, PASSAGE, KEPT = (5, 6), (12, 25), (6, 19)
#: Tokens in front of which no edit of a short passage is allowed: texts of the same manner share short runs with few differing words.
FIRM = (4, 10)
#: Longest gap between linked runs, in tokens.
GAP = 8
#: Sketch hashes in one broadcast.
BLOCK = 2_000_000

#: Tags of any length where they have attributes, other angle brackets around little text, entities, targets of links.
_MARKUP = re.compile(r"<[^<>\s][^<>]{0,200}>|</?[a-zA-Z][\w:-]*+\s++[\w:-]++\s*+=[^<>]*+>|&(?:[a-z]{2,8}|#\d{1,6});|\]\([^()\s]++\)")
_SCRIPTS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー]"


def _class(pattern: str, first: int, last: int) -> str:
    """A character class of the standard engine, which is faster, for a class of properties over a range of code points."""
    points = [ord(c) for c in regex.findall(pattern, "".join(chr(c) for c in range(first, last) if not 0xD800 <= c < 0xE000))]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_WORD = rf"(?!{_SCRIPTS})[\p{{L}}\p{{M}}\p{{N}}]"
_PLANE, _ALL = 0x10000, 0x20000
#: The first plane by itself is one table; beyond it a class is searched range by range. Ideographs fill the planes above.
_TOKEN = re.compile(f"[{_class(_WORD, 0, _PLANE)}]+|[{_class(_SCRIPTS, 0, _PLANE)}]")
_SOLID = re.compile(f"[{_class(_SCRIPTS, 0, _ALL)}\U00020000-\U0003fffd]")
_TOKEN_ANY = re.compile(f"[{_class(_WORD, 0, _ALL)}\U000e0100-\U000e01ef]+|{_SOLID.pattern}")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_JOINED = re.compile(r"(?<=\w)['’­​-‍⁠](?=\w)")


def tokens(text: str | None) -> list[str]:
    """Words, and single characters of scripts without spaces. NULL has none."""
    if not text:
        return []
    plain = unicodedata.normalize("NFKC", _MARKUP.sub(" ", text)).casefold()
    if _BEYOND.search(plain):
        plain = _BEYOND.sub(lambda m: m.group() if unicodedata.category(m.group())[0] in "LMN" else " ", plain)
    return (_TOKEN_ANY if _BEYOND.search(plain) else _TOKEN).findall(_JOINED.sub("", plain))


def is_solid(words: list[str]) -> bool:
    """Whether a token list is mostly of characters of scripts without spaces."""
    return 2 * sum(1 for w in words if len(w) == 1 and _SOLID.match(w)) > len(words)


def token_hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hash of each token; equal on every machine."""
    for w in set(words):
        if w not in memo:
            h = 0xCBF29CE484222325
            for byte in w.encode("utf-8", "surrogatepass"):
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            memo[w] = h
    out = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(memo) > 500_000:
        memo.clear()
    return out


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of every run of ``size`` tokens."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch(shingles: np.ndarray, kind: int) -> np.ndarray:
    """Places of the shingles that are among the KEPT smallest of some passage window; all where the text has only one."""
    window = PASSAGE[kind] - SHINGLE[kind] + 1
    if len(shingles) <= window:
        return np.arange(len(shingles))
    views = np.lib.stride_tricks.sliding_window_view(shingles, window)
    kept = np.argpartition(views, KEPT[kind] - 1, axis=1)[:, : KEPT[kind]]
    return np.unique(kept + np.arange(len(views))[:, None])


def allowed_edits(span: int, kind: int) -> int:
    """About one in ten. Words: none below FIRM + 10, one in ten up to 40. Characters: below 50 one in ten of what goes beyond
    FIRM."""
    if span >= (40, 50)[kind]:
        return (span + span // 20) // 10
    if kind == 0:
        return span // 10 if span >= FIRM[0] + 10 else 0
    return max(0, span - FIRM[kind]) // 10


def least_run(kind: int) -> int:
    """Tokens of the longest run of equal tokens that every allowed chain has: edits cut a span into one part more than there
    are edits."""
    return min(-(-(n - allowed_edits(n, kind)) // (allowed_edits(n, kind) + 1)) for n in range(PASSAGE[kind], 5000))


def _runs(places: np.ndarray, others: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(begin, end, diagonal) in the item of maximal runs of equal tokens that hold a shared shingle."""
    diagonals = others - places
    order = np.lexsort((places, diagonals))
    d, i = diagonals[order], places[order]
    starts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)))
    ends = np.append(starts[1:], len(i)) - 1
    return list(zip(i[starts].tolist(), (i[ends] + size).tolist(), d[starts].tolist()))


def _distance(one: list[int], other: list[int]) -> int:
    """Tokens changed, dropped or added between two short gaps; a single equal token between two edits is none."""
    last = list(range(len(other) + 1))
    for i, x in enumerate(one, 1):
        row = [i]
        for j, y in enumerate(other, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


LEAST_RUN = (least_run(0), least_run(1))


def best_passage(item: np.ndarray, document: np.ndarray, places: np.ndarray, others: np.ndarray, kind: int) -> tuple[int, int]:
    """(span, edits) in tokens of the longest chain whose edits are allowed.

    ``places`` and ``others`` are where shared shingles stand in item and document. Runs of equal tokens are linked where
    both gaps are small; a gap costs the edits between its sides.
    """
    if len(places) <= LEAST_RUN[kind] - SHINGLE[kind]:
        return 0, 0
    runs = _runs(places, others, SHINGLE[kind])
    if max(b - a for a, b, _ in runs) < LEAST_RUN[kind]:
        return 0, 0
    extra: list[tuple[int, int, int]] = []
    for a, b, d in runs:  # short equal runs behind and before a gap of one or two tokens on a near diagonal
        for side in (1, -1):
            at, shift = (b if side > 0 else a - 1), d
            for _ in range(6):
                found = None
                for gap in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2)):
                    i, j = at + side * gap[0], at + shift + side * gap[1]
                    n = 0
                    while 0 <= i + side * n < len(item) and 0 <= j + side * n < len(document) and item[i + side * n] == document[j + side * n]:
                        n += 1
                    if n >= 2 and (found is None or n > found[0]):
                        found = (n, i, j)
                    if n >= 3:
                        break
                if found is None:
                    break
                n, i, j = found
                low = i if side > 0 else i - n + 1
                extra.append((low, low + n, j - i))
                at, shift = (i + n if side > 0 else i - n), j - i
    runs = sorted({*runs, *extra})
    best = (0, 0)
    # For each run the ways to reach it: (begin of the chain in the item, edits so far). Earlier runs that it can follow
    # lie on near diagonals and end near its begin.
    by_diagonal: dict[int, list[int]] = {}
    chains: list[list[tuple[int, int]]] = []
    for a, b, d in runs:
        mine = {(a, 0)}
        for near in range(d - GAP, d + GAP + 1):
            for q in reversed(by_diagonal.get(near, ())):
                a2, b2, d2 = runs[q]
                if b2 < a - GAP:
                    break
                lap = max(0, b2 - a, (b2 + d2) - (a + d))
                if b - a <= lap:
                    continue
                gap = max(a + lap - b2, a + d + lap - (b2 + d2))
                if gap <= GAP:
                    if gap >= 2 and lap == 0 and a > b2 and a + d > b2 + d2:
                        gap = _distance(item[b2:a].tolist(), document[b2 + d2 : a + d].tolist())
                    mine.update((s, e + gap) for s, e in chains[q])
        fewest: dict[int, int] = {}
        for s, e in mine:
            fewest[s] = min(e, fewest.get(s, e))
        chains.append(list(fewest.items()))
        by_diagonal.setdefault(d, []).append(len(chains) - 1)
        for s, e in fewest.items():
            span = b - s
            if span > best[0] and e <= allowed_edits(span, kind):
                best = (span, e)
    return best


def _found(block: dict, least: tuple[int, int]):
    """mapInArrow function: documents (_id, _text) to (item_id, _id, span, edits) over one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = block.value if hasattr(block, "value") else block
        memo: dict[str, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                words = tokens(text)
                if len(words) < PASSAGE[0] // 2:
                    continue
                hashes = token_hashes(words, memo)
                for kind in (0, 1):
                    keys, owners, items = data[kind]
                    if not len(keys):
                        continue
                    shingles = shingle_hashes(hashes, SHINGLE[kind])
                    at = np.searchsorted(keys, shingles)
                    at[at == len(keys)] = 0
                    if not (keys[at] == shingles).any():
                        continue
                    # Items with a sketch hash in the document; then all exact shared shingles of each.
                    left = np.searchsorted(keys, shingles[keys[at] == shingles])
                    right = np.searchsorted(keys, shingles[keys[at] == shingles], side="right")
                    hit = {int(owners[k]) for a, b in zip(left, right) for k in range(a, b)}
                    order = np.argsort(shingles, kind="stable")
                    ranked = shingles[order]
                    for owner in hit:
                        item_id, item, own = items[owner]
                        low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, side="right")
                        met = np.flatnonzero(high > low)
                        places = np.repeat(met, (high - low)[met])
                        others = order[np.concatenate([np.arange(low[k], high[k]) for k in met])]
                        span, edits = best_passage(item, hashes, places, others, kind)
                        if span >= least[kind]:
                            rows.append((item_id, doc, span, edits))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["item_id", "_id", "span", "edits"]).astype({"span": "int32", "edits": "int32"}), preserve_index=False) if rows else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int64()), batch.column("_id").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["item_id", "_id", "span", "edits"]
            )

    return run


def item_blocks(items: list[tuple[int, str]]) -> list[dict]:
    """Sketches and tokens of the items, in blocks of at most BLOCK sketch hashes (an item is never divided)."""
    memo: dict[str, int] = {}
    blocks: list[dict] = []
    held: list = [[], []]
    size = 0

    def close() -> None:
        nonlocal held, size
        out = {}
        for kind in (0, 1):
            keys = np.concatenate([h[0] for h in held[kind]]) if held[kind] else np.zeros(0, np.uint64)
            owners = np.concatenate([np.full(len(h[0]), k) for k, h in enumerate(held[kind])]) if held[kind] else np.zeros(0, int)
            order = np.argsort(keys, kind="stable")
            out[kind] = (keys[order], owners[order], [h[1] for h in held[kind]])
        blocks.append(out)
        held, size = [[], []], 0

    for item_id, text in items:
        words = tokens(text)
        kind = int(is_solid(words))
        hashes = token_hashes(words, memo)
        shingles = shingle_hashes(hashes, SHINGLE[kind])
        keys = np.unique(shingles[sketch(shingles, kind)])
        if size and size + len(keys) > BLOCK:
            close()
        held[kind].append((keys, (item_id, hashes, shingles)))
        size += len(keys)
    if size:
        close()
    return blocks


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, least: tuple[int, int] = PASSAGE) -> DataFrame:
    """(item_id, id_col, span, edits) of every document that holds a passage of an item, once for each pair.

    ``items`` has item_id (long) and text; it is the stated query set and is read to the driver, where it is cut into
    blocks. Items with fewer tokens than a shingle have no leaks. NULL and empty texts on either side give no rows;
    equal items are found each; repeated document rows give one row. Other columns are not carried.
    """
    spark: SparkSession = documents.sparkSession
    listed = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator()]
    kind = documents.schema[id_col].dataType.simpleString()
    two = documents.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where(F.col("_text").isNotNull())
    schema = f"item_id long, _id {kind}, span int, edits int"
    found = spark.createDataFrame([], schema)
    for block in item_blocks(listed):
        found = found.unionByName(two.mapInArrow(_found(spark.sparkContext.broadcast(block), least), schema))
    return found.groupBy("item_id", "_id").agg(F.max("span").alias("span"), F.min("edits").alias("edits")).withColumnRenamed("_id", id_col)
