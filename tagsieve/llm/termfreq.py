"""Frequency of every distinct term: occurrences, records, and a mark for those too rare or too common.

Method: (term, record) pairs are range-partitioned and sorted externally by Spark; within a partition a run-length
scan over the sorted pairs counts occurrences and distinct records of every run of equal terms. Ranges are cut on
(term, record), so the run of a hot term may span several partitions: it does not have to fit one task. Each partition
emits one row per run, and a record whose pairs were split by a range boundary cannot exist, because equal
(term, record) pairs share a range. The runs of the same term are then added up.

The sum over runs is an ordinary aggregation with partial sums, so a hot term reaches the exchange as one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.session import written

RARE_ROWS = 2
COMMON_PERCENT = 8


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; NULL equals NULL only."""
    differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
    return pc.or_(differs, pc.xor(column[1:].is_null(), column[:-1].is_null())).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of batches sorted by field, term and record: a row for each run of equal terms in each batch.

    A run that continues in the next batch gives a further row; a record that does so is not counted again.
    """
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        field, term, rec = batch.column("field"), batch.column("term"), batch.column("rec_id")
        new_term = np.ones(n, dtype=bool)
        new_term[1:] = _changed(field) | _changed(term)
        new_record = new_term.copy()
        new_record[1:] |= _changed(rec)
        first = (field[0].as_py(), term[0].as_py(), rec[0].as_py())
        new_record[0] = first != last
        last = (field[n - 1].as_py(), term[n - 1].as_py(), rec[n - 1].as_py())
        starts = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [
                field.take(pa.array(starts)).cast(pa.string()),
                term.take(pa.array(starts)).cast(pa.string()),
                pa.array(np.diff(np.append(starts, n)).astype(np.int64)),
                pa.array(np.add.reduceat(new_record.astype(np.int64), starts)),
            ],
            names=["field", "term", "occurrences", "records"],
        )


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of a frame (field, term, rec_id) with one row for each occurrence.

    Rows with a NULL field or term, or an empty term, are left out; rows with a NULL rec_id count as one record.
    Repeated pairs count as occurrences but not as records. An empty frame gives no rows. Other columns are ignored.
    """
    kept = pairs.select("field", "term", "rec_id").where(F.col("field").isNotNull() & (F.col("term") != ""))
    # Range partitioning reads its input twice (once to find the bounds); the written pairs spare the second making.
    ordered = written(kept).repartitionByRange("field", "term", "rec_id").sortWithinPartitions("field", "term", "rec_id")
    runs = ordered.mapInArrow(_runs, "field string, term string, occurrences long, records long")
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def usefulness(records: Column, rows: Column) -> Column:
    """'rare', 'common' or NULL. Exact integer arithmetic; rare wins where both hold."""
    return F.when(records <= RARE_ROWS, "rare").when(100 * records >= COMMON_PERCENT * rows, "common")
