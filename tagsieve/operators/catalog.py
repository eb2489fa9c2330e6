"""Catalog search, lookups, counts and changes. A catalog has id, name, series, tags, image_url, rank, danbooru_tag, source."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions.text import fold, like_contains, like_folded, search_terms, search_terms_of
from tagsieve.session import written

COLUMNS = ["id", "name", "series", "tags", "image_url", "rank", "danbooru_tag", "source"]
SEARCHED = ["name", "tags", "danbooru_tag"]
PAGE_SIZE, LARGEST_PAGE, CARDS_A_PAGE = 30, 30, 24
#: Terms of queries that are sent to the executors at once; more of them mean more passes over the catalog.
BLOCK = 1_000_000
#: Found pairs that a task holds before it hands them on.
PAIRS = 200_000


def with_default_source(catalog: DataFrame) -> DataFrame:
    """Older catalogs lack source and danbooru_tag; a NULL source is ``danbooru``."""
    for c in ("danbooru_tag", "source"):
        if c not in catalog.columns:
            catalog = catalog.withColumn(c, F.lit(None).cast("string"))
    return catalog.withColumn("source", F.coalesce("source", F.lit("danbooru")))


def tag_missing() -> Column:
    return F.col("danbooru_tag").isNull() | (F.col("danbooru_tag") == "")


def condition(query: str = "", series: str | None = None, tag_status: str = "All", source: str | None = None) -> Column:
    """All clauses of a search that can be stated as a predicate; clauses without effect are left out."""
    parts = [reduce(lambda a, b: a | b, [F.coalesce(like_contains(c, t), F.lit(False)) for c in SEARCHED]) for t in search_terms(query)]
    if series and series != "All":
        parts.append(fold("series") == fold(F.lit(series)))
    if tag_status == "Missing":
        parts.append(tag_missing())
    elif tag_status == "Has":
        parts.append(~tag_missing())
    if source and source != "both":
        parts.append(F.col("source") == source)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(catalog: DataFrame, query: str = "", series: str | None = None, tag_status: str = "All", source: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows that satisfy every clause. ``ids``: a frame with id; an empty one gives no rows, None does not filter."""
    found = catalog.where(condition(query, series, tag_status, source)).select(*COLUMNS)
    return found if ids is None else found.join(ids.select("id").distinct(), "id", "left_semi").select(*COLUMNS)


def page_size(size: object) -> int:
    """A setting as page size: what is no number gives PAGE_SIZE, numbers are kept between 1 and LARGEST_PAGE."""
    try:
        return max(1, min(int(size), LARGEST_PAGE))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return PAGE_SIZE


def page_number(number: object, pages: int) -> int:
    """A typed page number: what is no number gives 1, numbers are kept between 1 and the number of pages."""
    try:
        return max(1, min(int(float(number)), pages))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return 1


def page_at(rows: DataFrame, number: object, size: object = PAGE_SIZE) -> DataFrame:
    """The page with a typed number, the last one where it lies beyond the end; rows are counted first."""
    pages = max(1, -(-rows.count() // page_size(size)))
    return page(rows, page_number(number, pages), page_size(size))


def row_at(rows: DataFrame, index: int) -> DataFrame:
    """The row of a page by its place from 0 in order of rank and id; an empty card, all NULL, where there is none."""
    found = rows.orderBy(F.asc_nulls_first("rank"), "id").offset(max(0, index)).limit(1 if index >= 0 else 0)
    one = rows.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return one.join(found.withColumn("_one", F.lit(1)), "_one", "left").select(*rows.columns)


def is_populated(spark: SparkSession, path: str) -> bool:
    """Whether a catalog is there and has a row; anything that cannot be read counts as empty."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception:  # noqa: BLE001
        return False


def page(rows: DataFrame, number: int = 1, size: object = PAGE_SIZE) -> DataFrame:
    """One page in order of rank (NULL first), then id."""
    size = page_size(size)
    return rows.orderBy(F.asc_nulls_first("rank"), "id").offset((max(1, number) - 1) * size).limit(size)


def totals(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Number of rows and of pages; at least one page."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.expr(f"(total + {size - 1}) div {size}")))


def search_batch(catalog: DataFrame, queries: DataFrame, most_terms: int = 1000) -> DataFrame:
    """(query, id) for a stated, size-checked list of queries (column query), all terms of each in any searched column."""
    wanted = queries.select("query", F.array_distinct(search_terms_of("query")).alias("terms")).where(F.size("terms") > 0).distinct()
    listed = wanted.select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    rows = listed.limit(most_terms + 1).collect()
    if len(rows) > most_terms:
        raise ValueError(f"more than {most_terms} terms; state the queries in blocks")
    terms = sorted({r["term"] for r in rows})
    if not terms:
        return catalog.select(F.lit("").alias("query"), "id").limit(0)
    # Constant terms become plain substring tests; a row gives the terms that it holds, and only those meet their queries.
    folded = catalog.select("id", *[fold(c).alias(c) for c in SEARCHED])
    tests = [F.when(reduce(lambda a, b: a | b, [F.coalesce(like_folded(c, t), F.lit(False)) for c in SEARCHED]), F.lit(t)) for t in terms]
    # The outer form keeps the optimizer from copying all tests into a filter below.
    held = folded.select("id", F.explode_outer(F.array_compact(F.array(*tests))).alias("term")).where(F.col("term").isNotNull())
    table = catalog.sparkSession.createDataFrame([(r["query"], r["n"], r["term"]) for r in rows], "query string, n int, term string")
    pairs = held.join(F.broadcast(table), "term")
    return pairs.groupBy("query", "n", "id").agg(F.count(F.lit(1)).alias("matched")).where(F.col("matched") == F.col("n")).select("query", "id")


class Searches:
    """Folded terms of many queries; finds the queries whose terms all stand in a row.

    An automaton finds the terms of a row in one reading. A term with wildcards is found by its longest literal part and
    then tested as a whole. Each query is looked up under its two terms that the fewest queries have.
    """

    def __init__(self, queries: list[list[str]]) -> None:
        import ahocorasick  # here, so that the other operators work without it

        shared = Counter(t for terms in queries for t in set(terms))
        number = {t: k for k, t in enumerate(shared)}
        self.automaton = ahocorasick.Automaton()
        self.wild: dict[int, list[tuple[int, re.Pattern[str]]]] = defaultdict(list)
        literal_number = {"": -1}
        for term, k in number.items():
            literals = re.split("[%_]+", term)
            if len(literals) == 1:
                literal_number[term] = k
        for term, k in number.items():
            literals = re.split("[%_]+", term)
            if len(literals) > 1:
                pattern = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in term)
                at = literal_number.setdefault(max(literals, key=len), len(number) + len(literal_number))
                self.wild[at].append((k, re.compile(pattern, re.DOTALL)))
        for literal, k in literal_number.items():
            if literal:
                self.automaton.add_word(literal, k)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single: dict[int, list[int]] = defaultdict(list)
        self.several: dict[int, dict[int, list[tuple[int, frozenset[int]]]]] = defaultdict(lambda: defaultdict(list))
        for q, terms in enumerate(queries):
            first, *rest = [number[t] for t in sorted(set(terms), key=lambda t: (shared[t], -len(t), t))]
            if rest:
                self.several[first][rest[0]].append((q, frozenset(rest[1:])))
            else:
                self.single[first].append(q)

    def of(self, texts: Sequence[str | None]) -> list[int]:
        texts = [t for t in texts if t is not None]
        # Terms hold no white space, so none is found across the line ends.
        held = {k for _, k in self.automaton.iter("\n".join(texts))} if len(self.automaton) else set()
        if self.wild:
            tests = [test for at in (held | {-1}) & self.wild.keys() for test in self.wild[at]]
            held |= {k for k, pattern in tests if any(pattern.search(t) for t in texts)}
        out = [q for k in held & self.single.keys() for q in self.single[k]]
        for k in held & self.several.keys():
            seconds = self.several[k]
            for second in held & seconds.keys():
                out += [q for q, rest in seconds[second] if rest <= held]
        return out


def search_all(catalog: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(query, id) as in search_batch, for any number of queries: one pass over the catalog for every ``block`` of terms."""
    terms = F.array_distinct(F.transform(search_terms_of("query"), fold)).alias("terms")
    wanted = queries.select("query", terms).where(F.size("terms") > 0).distinct()
    parts, rows, size = [], [], 0
    for r in wanted.toLocalIterator():
        rows.append((r["query"], r["terms"]))
        size += len(r["terms"])
        if size >= block:  # written, so that the executors hold one block at a time
            parts.append(written(_search_block(catalog, rows)))
            rows, size = [], 0
    return reduce(DataFrame.unionByName, [*parts, _search_block(catalog, rows)] if rows or not parts else parts)


def _search_block(catalog: DataFrame, queries: list[tuple[str, list[str]]]) -> DataFrame:
    shared = catalog.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, searches = pa.array([q for q, _ in shared.value], pa.string()), Searches([t for _, t in shared.value])
        for batch in batches:
            ids, found, at = batch.column("id"), [], []
            for k, texts in enumerate(zip(*[batch.column(c).to_pylist() for c in SEARCHED])):
                here = searches.of(texts)
                found += here
                at += [k] * len(here)
                if len(at) >= PAIRS:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(found, pa.int32())), ids.take(pa.array(at, pa.int32()))], names=["query", "id"])
                    found, at = [], []
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found, pa.int32())), ids.take(pa.array(at, pa.int32()))], names=["query", "id"])

    kind = catalog.schema["id"].dataType.simpleString()
    return catalog.select("id", *[fold(c).alias(c) for c in SEARCHED]).mapInArrow(run, f"query string, id {kind}")


def first_by_name(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """For each wanted name (column wanted), the first row by id whose name is equal but for ASCII case."""
    wanted = names.select(F.col("wanted"), fold("wanted").alias("_key")).distinct()
    firsts = catalog.join(wanted.select("_key").distinct(), fold("name") == F.col("_key"), "left_semi").groupBy(fold("name").alias("_key")).agg(F.min_by(F.struct("id", "name", "series", "tags", "image_url", "rank", "danbooru_tag", "source"), "id").alias("r"))
    return wanted.join(firsts, "_key").select("wanted", "r.*")


def pending(catalog: DataFrame, most: int = 500) -> DataFrame:
    """Work queue: rows without a tag in order of id."""
    return catalog.where(tag_missing()).orderBy("id").limit(most).select("id", "name", "series", "tags")


def counts(catalog: DataFrame) -> DataFrame:
    """Rows, rows without and with a tag for each source."""
    missing = F.sum(tag_missing().cast("long"))
    return catalog.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), missing.alias("pending"), (F.count(F.lit(1)) - missing).alias("tagged"))


def series_counts(catalog: DataFrame) -> DataFrame:
    """Rows of every non-empty series as it is written; the caller orders by the folded, then the raw name."""
    return catalog.where(F.col("series") != "").groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def resume_points(catalog: DataFrame, page_size: int = CARDS_A_PAGE) -> DataFrame:
    """Highest rank of each source and the page at which reading goes on."""
    top = catalog.groupBy("source").agg(F.coalesce(F.max("rank"), F.lit(0).cast("long")).alias("max_rank"))
    return top.withColumn("start_page", F.expr(f"max_rank div {page_size} + 1"))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append incoming rows whose rank is new; of equal ranks the smallest id stays, NULL ranks never clash, a NULL name or
    tags list is refused."""
    good = incoming.where(F.col("name").isNotNull() & F.col("tags").isNotNull())
    ranked = good.where(F.col("rank").isNotNull())
    fresh = ranked.join(existing.select("rank").where(F.col("rank").isNotNull()).distinct(), "rank", "left_anti")
    kept = fresh.groupBy("rank").agg(F.min("id").alias("id"))
    rows = fresh.join(kept, ["rank", "id"], "left_semi").select(*COLUMNS)
    return existing.select(*COLUMNS).unionByName(rows).unionByName(good.where(F.col("rank").isNull()).select(*COLUMNS))


def apply_updates(catalog: DataFrame, updates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` of the rows whose id is in ``updates`` (unique by id); unknown ids change nothing."""
    new = updates.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = catalog.join(new, "id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.select(*catalog.columns)


def changed_only(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``after`` (same ids) that differ in one of the columns."""
    old = before.select("id", *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns])
    return after.join(old, "id").where(differs).select(*after.columns)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``position`` from 0 in a global order without bringing the rows into one partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()  # one row a partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["_part"], total - r["first"]))
        total += r["n"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    return fixed.join(F.broadcast(table), "_part").withColumn("position", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def systematic_sample(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Every step-th row in order, at most k, with step = max(1, rows div k)."""
    step = max(1, df.count() // k)
    return numbered(df, *order).where((F.col("position") % step == 0) & (F.col("position") < step * k))
