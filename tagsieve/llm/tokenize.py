"""Encoding of texts with a byte-level BPE rank file.

The text is cut by the pattern of the vocabulary into pieces; each distinct piece of a batch is merged once. Pieces are put
into buckets by length, a bucket is a padded matrix of token ids, and in every round each row merges its leftmost pair
of minimum rank: ranks come from a hash table over pairs in numpy, and the row is then compacted by one place. Rows that
have no pair left leave the matrix. Pieces longer than LONGEST bytes, for which rounds over a matrix would cost the
square of the length, are merged exactly by a heap over a linked list.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every function takes another path.
FOLDER = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST = 256
#: Rows of a matrix, and pieces remembered by a worker.
ROWS, MEMO = 65_536, 300_000
_NONE = np.int64(2**31)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class PairTable:
    """Open addressing over pairs (a, b) of ids; the value is the rank, which is also the id, of the merged token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, _NONE, dtype=np.int64)
        left, ranked = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = left[put], ranked[put]
            left, ranked, slot = left[~put], ranked[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair, _NONE where there is none or where either side is padding (-1)."""
        shape = a.shape
        keys = ((a << 32) | b).ravel()
        out = np.full(len(keys), _NONE, dtype=np.int64)
        at = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot, keys = self._slot(keys[at]), keys[at]
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Encoder:
    """Encodes texts as lists of ids; holds a bounded memory of merged pieces."""

    def __init__(self, content: bytes, pattern: str = PATTERN) -> None:
        ranks = read_ranks(content)
        self.table = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pattern = regex.compile(pattern)
        self.memo: dict[bytes, list[int]] = {}

    def merge_matrix(self, table: np.ndarray) -> list[list[int]]:
        """Merge all rows of a matrix of ids padded with -1."""
        n, width = table.shape
        done: list[list[int] | None] = [None] * n
        rows = np.arange(n)
        ranks = self.table.ranks(table[:, :-1], table[:, 1:]) if width > 1 else np.full((n, 1), _NONE)
        places = np.arange(width)
        while len(rows):
            where = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), where]
            live = best < _NONE
            if not live.all():
                for k in np.flatnonzero(~live):
                    row = table[k]
                    done[rows[k]] = row[row >= 0].tolist()
                rows, table, ranks, where, best = rows[live], table[live], ranks[live], where[live], best[live]
                if not len(rows):
                    break
            # Compaction: everything behind the merged pair moves one place to the left.
            source = places[None, :-1] + (places[None, :-1] > where[:, None])
            each = np.arange(len(rows))
            table = table[each[:, None], source]
            table[each, where] = best
            if table.shape[1] == 1:
                for k, r in enumerate(rows):
                    done[r] = table[k].tolist()
                break
            pair_source = source[:, :-1] if ranks.shape[1] > 1 else source[:, :0]
            ranks = ranks[each[:, None], pair_source]
            places = places[: table.shape[1]]
            # Only the two pairs at the merge have new ranks.
            for shift in (-1, 0):
                at = where + shift
                ok = (at >= 0) & (at < table.shape[1] - 1)
                ranks[each[ok], at[ok]] = self.table.ranks(table[each[ok], at[ok]], table[each[ok], at[ok] + 1])
        return [d if d is not None else [] for d in done]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece by a heap of pairs over a linked list."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        first = self.table.ranks(ids[:-1], ids[1:])
        heap = [(int(r), int(i)) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        token, n = ids.tolist(), len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int, j: int) -> int:
            return int(self.table.ranks(np.array([token[i]]), np.array([token[j]]))[0])

        current = {i: int(r) for i, r in enumerate(first) if r < _NONE}
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or current.get(i) != r:
                continue
            j = after[i]
            token[i], alive[j], after[i] = r, False, after[j]
            current.pop(i), current.pop(j, None)
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    new = rank(left, after[left])
                    if new < _NONE:
                        current[left] = new
                        heapq.heappush(heap, (new, left))
                    else:
                        current.pop(left, None)
        return [t for t, ok in zip(token, alive) if ok]

    def learn(self, pieces: set[bytes]) -> None:
        """Merge the pieces that are not remembered yet, bucket by bucket."""
        if len(self.memo) > MEMO:
            self.memo = {}
        buckets: dict[int, list[bytes]] = {}
        for piece in pieces:
            if piece not in self.memo:
                if len(piece) > LONGEST:
                    self.memo[piece] = self.merge_long(piece)
                else:
                    buckets.setdefault(-(-len(piece) // 4) * 4, []).append(piece)
        for width, bucket in buckets.items():
            step = max(1, ROWS * 16 // width)
            for at in range(0, len(bucket), step):
                part = bucket[at : at + step]
                raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in part), np.uint8).reshape(len(part), width)
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                table = np.where(np.arange(width) < sizes[:, None], self.bytes[raw], -1)
                self.memo.update(zip(part, self.merge_matrix(table)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty and a NULL text give the empty list."""
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(t)] if t else [] for t in texts]
        self.learn({p for pieces in cut for p in pieces})
        missing = [p for pieces in cut for p in pieces if p not in self.memo]
        if missing:
            self.learn(set(missing))
        return [[i for p in pieces for i in self.memo[p]] for pieces in cut]


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> bytes:
    return Path(folder, f"{name}.tiktoken").read_bytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(token: str, content: bytes, pattern: str) -> Encoder:
    """The encoder of this worker process; the tasks of a query share it and its memory of pieces."""
    if token not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[token] = Encoder(content, pattern)
    return _ENCODERS[token]


def encode_texts(df: DataFrame, id_col: str, text_col: str, content: bytes, pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids array<int>) for every row of the frame; other columns are not carried.

    Empty and NULL texts give the empty list, as do texts of any length without limit their ids; strings of special
    tokens are ordinary text. Repeated rows give repeated rows. The vocabulary (fixed size) travels once to each worker.
    """
    shared = df.sparkSession.sparkContext.broadcast(content)

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(token, shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = encoder.encode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    two = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return two.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)
