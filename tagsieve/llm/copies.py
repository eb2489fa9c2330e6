"""Duplicates hidden by formatting differences.

Columns are dictionary-encoded: in every Arrow batch each distinct value of a column is canonicalised once and given an
integer identifier, a digest of its canonical form, which needs no shared state and survives recomputation. A record
becomes the tuple (source identifier, name identifier, sorted identifiers of its tag set) of 64-bit integers, with the
sum of a second, independent digest of each identifier as check. The compact tuples are grouped; the group key is the
whole tuple with its check, so that two different records are merged only if 128 bits agree: for 10^10 records with a
chance of some 10^-19.

Counting pre-aggregates in each task. To list the members, groups of one record are left out and the rest meet the
records on the tuple. A group of more than HOT records, and of more than one record in HOTTEST of all, is hot: it is
spread over salts in proportion to its copies. There are at most HOTTEST such groups, so their keys can be sent to
every task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsieve.session import written

#: Records that one task joins for a group; fewer than one record in HOTTEST of all never makes a group hot.
HOT, HOTTEST = 200_000, 10_000
_COLUMNS = ["key", "source_id", "name_id", "tag_ids", "check"]
_WORD = re.compile(r"[^\W_]+")
_MEMO = 200_000


def canonical_source(value: str | None, default: str = "danbooru") -> str:
    """Letters and digits in lower case; NULL is the default source."""
    return "".join(c for c in (default if value is None else value).lower() if c.isalnum())


def canonical_name(value: str | None) -> str:
    """The words in lower case, sorted; repeated words stay. NULL has no words."""
    return " ".join(sorted(_WORD.findall((value or "").lower())))


def canonical_tag(value: str | None) -> str:
    """Plain form: lower case, ``_`` as space, no backslashes, single spaces."""
    return " ".join((value or "").lower().replace("_", " ").replace("\\", "").split())


def digest(text: str) -> tuple[int, int]:
    """Two independent 64-bit digests."""
    both = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little")


def _encode(values: pa.Array, canonical: Callable[[str | None], str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of a string array and their checks; each distinct value of the batch is looked at once."""
    coded = values.cast(pa.string()).dictionary_encode(null_encoding="encode")
    ids, checks = np.empty(len(coded.dictionary), dtype=np.int64), np.empty(len(coded.dictionary), dtype=np.uint64)
    if len(memo) > _MEMO:
        memo.clear()
    for k, value in enumerate(coded.dictionary.to_pylist()):
        if value not in memo:
            memo[value] = digest(canonical(value))
        ids[k], checks[k] = memo[value]
    places = coded.indices.to_numpy(zero_copy_only=False)
    return (ids[places], checks[places]) if len(values) else (ids, checks)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memos: tuple[dict, dict, dict] = ({}, {}, {})
    for batch in batches:
        n = batch.num_rows
        source, source_check = _encode(batch.column("source"), canonical_source, memos[0])
        name, name_check = _encode(batch.column("name"), canonical_name, memos[1])
        lists = batch.column("vals")
        rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        flat, flat_check = _encode(lists.flatten(), canonical_tag, memos[2])
        order = np.lexsort((flat, rows))
        rows, flat, flat_check = rows[order], flat[order], flat_check[order]
        kept = np.append(True, (rows[1:] != rows[:-1]) | (flat[1:] != flat[:-1])) if len(rows) else np.zeros(0, bool)
        rows, flat, flat_check = rows[kept], flat[kept], flat_check[kept]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat_check, dtype=np.uint64)])
        check = sums[offsets[1:]] - sums[offsets[:-1]] + source_check * np.uint64(3) + name_check * np.uint64(5)
        tags = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(source), pa.array(name), tags, pa.array(check.view(np.int64))], names=["id", "source_id", "name_id", "tag_ids", "check"])


def encoded_records(records: DataFrame) -> DataFrame:
    """(id, source_id, name_id, tag_ids, check, key) of records (id, source, name, vals array<string>)."""
    tuples = records.select("id", "source", "name", "vals").mapInArrow(_tuples, "id long, source_id long, name_id long, tag_ids array<long>, check long")
    return tuples.withColumn("key", F.xxhash64("source_id", "name_id", "tag_ids"))


def copy_groups(encoded: DataFrame) -> DataFrame:
    """One row for each distinct record: its tuple, key, smallest id and number of copies (1 for records without copies)."""
    return encoded.groupBy(*_COLUMNS).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copy_members(encoded: DataFrame, hot: int = HOT) -> DataFrame:
    """(first_id, id) for every record that is not the first of its group.

    Records with NULL id are no members. Rows that repeat one id count as copies but are listed once in a group.
    """
    groups = written(copy_groups(encoded).where((F.col("copies") > 1) & F.col("first_id").isNotNull()))
    least = max(hot, encoded.count() // HOTTEST)
    salts = F.ceil(F.col("copies") / least).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*_COLUMNS, "salt", "first_id")
    spread_keys = F.broadcast(groups.where(F.col("copies") > least).groupBy("key").agg(F.max(salts).alias("salts")))  # at most HOTTEST rows
    members = encoded.where(F.col("id").isNotNull()).join(spread_keys, "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    # Repeats of one id meet where the join brought them: the same key and salt, without a further exchange.
    found = members.join(salted, [*_COLUMNS, "salt"]).where(F.col("id") != F.col("first_id"))
    return found.dropDuplicates([*_COLUMNS, "salt", "id"]).select("first_id", "id")
