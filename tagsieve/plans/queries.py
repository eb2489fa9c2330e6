"""Queries of the catalog operators over the driver's tables, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsieve.functions import text as T
from tagsieve.operators import cards, catalog, cleaning, dictionary, extras, profile, resolve, state, taglist
from tagsieve.plans.inputs import table
from tagsieve.session import shared_folder, spread, written
from tagsieve.sinks import writers
from tagsieve.sources import readers
from tagsieve.streaming import state as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = "haikafezely_(mothmark_orchestra)"
#: White space of any kind in RE2 and pieces of SQL that several oracles share.
WS = r"[\t-\r \x{85}\p{Z}]"
CATALOG = "(SELECT id, name, series, tags, image_url, rank, danbooru_tag, coalesce(source, 'danbooru') AS source FROM characters)"
ONCE = "(SELECT action_id, r.user_id, r.ts, r.act, r.char_id, r.typed FROM (SELECT action_id, min(struct_pack(received_at, ts, user_id, act, char_id, typed)) AS r FROM actions GROUP BY 1))"
UP, LOW = T.UPPER, T.LOWER


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_fold(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def sql_like(c: str, term: str) -> str:
    return f"coalesce({sql_fold(c)} LIKE '%{term.lower()}%', false)"


def sql_title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def sql_commas(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda t: {sql_strip('t')}), lambda t: t <> '')"


DICT = f"""(SELECT tag, min(line_no) AS line_no, arg_max(struct_pack(c := category, p := post_count, a := aliases), line_no) AS v FROM
 (SELECT line_no, {sql_strip('tag')} AS tag, CASE WHEN category IS NULL OR post_count IS NULL THEN 0 ELSE category END AS category,
  CASE WHEN category IS NULL OR post_count IS NULL THEN 0 ELSE post_count END AS post_count, {sql_commas('aliases')} AS aliases FROM danbooru_tags) WHERE tag <> '' GROUP BY tag)"""
DICT = f"(SELECT tag, line_no, v.c AS category, v.p AS post_count, v.a AS aliases FROM {DICT})"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def cat(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_default_source(table(spark, sf, "characters"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.load(table(spark, sf, "danbooru_tags"))


_BOTH = " AND ".join(f"({' OR '.join(sql_like(c, t) for c in catalog.SEARCHED)})" for t in ("mothmark", "hair"))


@query(f"SELECT * FROM {CATALOG} WHERE {_BOTH} AND source = 'danbooru' ORDER BY rank ASC NULLS FIRST, id LIMIT 30 OFFSET 30")
def catalog_search_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(catalog.search(cat(spark, sf), "mothmark, hair", source="danbooru"), 2)


@query(f"SELECT count(*) AS total, greatest(1, (count(*) + 29) // 30) AS pages FROM {CATALOG} WHERE {_BOTH}")
def catalog_search_total(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.totals(catalog.search(cat(spark, sf), "mothmark hair", source="both"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return state.once(table(spark, sf, "actions")).where(F.col("act") == "search").select(T.strip("typed").alias("query")).where(F.col("query") != "")


_TOP = f"(SELECT q AS query FROM (SELECT {sql_strip('typed')} AS q, count(*) AS n FROM {ONCE} WHERE act = 'search' GROUP BY 1) WHERE q <> '' ORDER BY n DESC, q LIMIT 20)"
_ANY = " OR ".join(f"coalesce({sql_fold(c)} LIKE '%' || {sql_fold('term')} || '%', false)" for c in catalog.SEARCHED)


@query(
    f"""WITH t AS (SELECT query, list_distinct(list_filter(regexp_split_to_array(query, '(,|{WS})+'), lambda x: x <> '')) AS terms FROM {_TOP}),
 e AS (SELECT query, len(terms) AS n, unnest(terms) AS term FROM t),
 h AS (SELECT query, n, id FROM characters JOIN e ON ({_ANY}) GROUP BY query, n, id HAVING count(*) = n)
 SELECT query, count(*) AS hits, min(id) AS first_id FROM h GROUP BY query"""
)
def catalog_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most typed queries (a top-k report), each against the whole catalog."""
    top = _typed(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(20).select("query")
    return catalog.search_batch(cat(spark, sf), top).groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"))


@query()
def catalog_search_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every typed query against the whole catalog; in SQL each row would be compared with each term."""
    found = catalog.search_all(spread(cat(spark, sf)), _typed(spark, sf).distinct())
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"))


@query(f"SELECT id, name, series, tags FROM {CATALOG} WHERE danbooru_tag IS NULL OR danbooru_tag = '' ORDER BY id LIMIT 500")
def catalog_pending(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pending(cat(spark, sf))


@query(f"SELECT id, danbooru_tag FROM {CATALOG} WHERE NOT (danbooru_tag IS NULL OR danbooru_tag = '')")
def catalog_has_tag(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(cat(spark, sf), tag_status="Has").select("id", "danbooru_tag")


@query(f"SELECT id FROM {CATALOG} WHERE danbooru_tag IS NULL OR danbooru_tag = ''")
def catalog_missing_tag(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(cat(spark, sf), tag_status="Missing").select("id")


@query(f"SELECT source, count(*) AS rows, count(*) FILTER (danbooru_tag IS NULL OR danbooru_tag = '') AS pending, count(*) FILTER (danbooru_tag <> '') AS tagged FROM {CATALOG} GROUP BY source")
def catalog_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts(cat(spark, sf))


@query("SELECT series, count(*) AS n FROM characters WHERE series <> '' GROUP BY series")
def catalog_series_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.series_counts(cat(spark, sf))


@query(f"SELECT id, series FROM characters WHERE {sql_fold('series')} = 'mothmark orchestra'")
def catalog_series_nocase(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(cat(spark, sf), series="Mothmark ORCHESTRA").select("id", "series")


@query(
    f"""WITH w AS (SELECT DISTINCT tag AS wanted, {sql_fold("replace(tag, '_', ' ')")} AS k FROM danbooru_tags WHERE category = 4),
 f AS (SELECT {sql_fold('name')} AS k, min(id) AS id FROM characters GROUP BY 1)
 SELECT w.wanted, c.id, c.name, c.source FROM w JOIN f USING (k) JOIN {CATALOG} c ON c.id = f.id"""
)
def catalog_get_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Exact lookup of every character of the dictionary."""
    tags = table(spark, sf, "danbooru_tags").where(F.col("category") == 4).select("tag").distinct()
    found = catalog.first_by_name(cat(spark, sf), tags.select(T.display_form("tag").alias("wanted")))
    return tags.withColumn("wanted", T.display_form("tag")).join(found, "wanted").select(F.col("tag").alias("wanted"), "id", "name", "source")


_FAVORITES = f"(SELECT user_id, char_id FROM {ONCE} WHERE act = 'favorite' AND char_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


@query(f"SELECT id, name FROM characters WHERE id IN (SELECT char_id FROM {_FAVORITES})")
def catalog_id_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    ids = state.favorites(table(spark, sf, "actions")).select(F.col("char_id").alias("id"))
    return catalog.search(cat(spark, sf), ids=ids).select("id", "name")


@query(f"SELECT id, id IN (SELECT char_id FROM {_FAVORITES}) AS favorite FROM characters")
def catalog_favorite_flag(spark: SparkSession, sf: str) -> DataFrame:
    ids = state.favorites(table(spark, sf, "actions")).select(F.col("char_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    return cat(spark, sf).select("id").join(ids, "id", "left").select("id", F.coalesce("_f", F.lit(False)).alias("favorite"))


_OVERRIDES = f"(SELECT char_id AS id, arg_max(struct_pack(t := typed), struct_pack(ts, action_id)).t AS tag FROM {ONCE} WHERE act = 'override' AND char_id IS NOT NULL GROUP BY 1)"


@query(f"SELECT c.id, CASE WHEN o.id IS NULL THEN c.danbooru_tag ELSE o.tag END AS danbooru_tag FROM characters c LEFT JOIN {_OVERRIDES} o ON o.id = c.id")
def catalog_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.apply_updates(cat(spark, sf), state.overrides(table(spark, sf, "actions")), ["danbooru_tag"]).select("id", "danbooru_tag")


@query(f"SELECT source, coalesce(max(rank), 0) AS max_rank, coalesce(max(rank), 0) // 24 + 1 AS start_page FROM {CATALOG} GROUP BY source")
def catalog_rank_max(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.resume_points(cat(spark, sf))


_OWN = "regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', '', 'g') = 'danbooru'"


@query(
    f"""WITH e AS (SELECT * FROM {CATALOG} WHERE {_OWN}), i AS (SELECT * FROM {CATALOG} WHERE NOT {_OWN} AND name IS NOT NULL AND tags IS NOT NULL),
 f AS (SELECT min(id) AS id FROM i WHERE rank IS NOT NULL AND rank NOT IN (SELECT rank FROM e WHERE rank IS NOT NULL) GROUP BY rank)
 SELECT id, rank, source FROM e UNION ALL SELECT id, rank, source FROM i WHERE rank IS NULL OR id IN (SELECT id FROM f)"""
)
def catalog_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all other sources added to those of the first one, however it is spelled."""
    rows, own = cat(spark, sf), T.source_key("source") == "danbooru"
    return catalog.insert_or_ignore(rows.where(own), rows.where(~own)).select("id", "rank", "source")


@query("SELECT id, name, r AS position FROM (SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS r, greatest(1, (SELECT count(*) FROM characters) // 100) AS s FROM characters) WHERE r % s = 0 AND r < s * 100")
def catalog_sample(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.systematic_sample(cat(spark, sf).select("id", "name"), 100, "id")


_NAMES = "CASE category WHEN 0 THEN 'general' WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright' WHEN 4 THEN 'character' WHEN 5 THEN 'meta' ELSE 'unknown' END"


@query(f"SELECT line_no, tag, category, post_count, aliases, {_NAMES} AS category_name FROM {DICT}")
def dict_load(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).select("line_no", "tag", "category", "post_count", "aliases", "category_name")


@query(f"SELECT tag, category, post_count, aliases, {_NAMES} AS category_name FROM {DICT}")
def dict_read_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary written as a CSV file, in file order and with quoting, and read by the CSV reader."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf, "danbooru_tags").orderBy("line_no").coalesce(1).select(F.col("tag").alias(" Tag "), "category", "post_count", "aliases")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="")
    return readers.read_dictionary(spark, path).select("tag", "category", "post_count", "aliases", "category_name")


@query(f"SELECT count(DISTINCT tag) AS tags FROM {DICT}")
def dict_tag_count(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).agg(F.count_distinct("tag").alias("tags"))


@query(f"SELECT line_no, tag, category, {_NAMES} AS category_name, post_count FROM {DICT} WHERE category IN (0, 4) AND post_count >= 500 AND (regexp_full_match(tag, '.*_ha[^a-h]r', 's') OR contains(tag, '*_ha[!a-h]r')) ORDER BY post_count DESC, line_no LIMIT 100")
def dict_search_glob(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.search(words(spark, sf), "*_HA[!a-h]r")


@query(
    f"""WITH w AS (SELECT DISTINCT antecedent_name AS wanted FROM tag_aliases UNION SELECT tag FROM danbooru_tags WHERE category = 3),
 h AS (SELECT w.wanted, 0 AS prio, d.line_no, d.tag FROM w JOIN {DICT} d ON d.tag = w.wanted UNION ALL
  SELECT w.wanted, 1, d.line_no, d.tag FROM w JOIN (SELECT unnest(aliases) AS a, line_no, tag FROM {DICT}) d ON d.a = w.wanted)
 SELECT wanted, arg_min(tag, prio * 1000000000 + line_no) AS tag, min(prio) AS by_alias FROM h GROUP BY wanted"""
)
def dict_lookup_alias(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "tag_aliases").select(F.col("antecedent_name").alias("wanted"))
    series = table(spark, sf, "danbooru_tags").where(F.col("category") == 3).select(F.col("tag").alias("wanted"))
    return dictionary.lookup(words(spark, sf), wanted.unionByName(series))


@query(
    f"""SELECT line_no, replace(tag, '_', ' ') AS tag, post_count, CAST(tag = 'kiarnhai_vilypho' AS INTEGER) AS exact,
 CAST(starts_with(tag, 'kiarnhai_vilypho_(') AND (length(tag) - length(replace(tag, '_(', ''))) = 2 AS INTEGER) AS bracket, CAST(starts_with(tag, 'kiarnhai_vilypho_') AS INTEGER) AS prefix
 FROM {DICT} WHERE category = 4 AND contains(tag, 'kiarnhai_vilypho') ORDER BY exact DESC, bracket DESC, prefix DESC, post_count DESC, length(tag), line_no LIMIT 10"""
)
def dict_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.ranked_search(words(spark, sf), " Kiarnhai Vilypho ")


@query(
    f"""SELECT key, arg_min(canonical, struct_pack(prio, place, c := canonical)) AS canonical FROM (
 SELECT lower(tag) AS key, 0 AS prio, -line_no AS place, tag AS canonical FROM {DICT} WHERE category = 4 UNION ALL
 SELECT lower(unnest(aliases)), 1, line_no, tag FROM {DICT} WHERE category = 4) GROUP BY key"""
)
def dict_alias_index(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.alias_index(words(spark, sf))


_RECORDS = f"SELECT t AS name, row_number() OVER (ORDER BY t) - 1 AS seq, n FROM (SELECT unnest(list_filter(regexp_split_to_array(coalesce(tag_string_copyright, ''), '{WS}+'), lambda x: x <> '')) AS t, count(*) AS n FROM posts GROUP BY 1)"


@query(
    f"""WITH r AS ({_RECORDS}), d AS {DICT} SELECT coalesce(d.tag, r.name) AS tag, coalesce(d.line_no, (SELECT max(line_no) FROM d) + r.seq + 1) AS line_no, CASE WHEN r.name IS NULL THEN d.category ELSE 3 END AS category,
 CASE WHEN r.name IS NULL THEN d.post_count ELSE r.n END AS post_count, CASE WHEN r.name IS NULL THEN d.aliases ELSE [] END AS aliases FROM d FULL JOIN r ON r.name = d.tag"""
)
def dict_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Copyright tags of the posts written over the dictionary, as records of an API would be."""
    each = table(spark, sf, "posts").select(F.explode(F.filter(F.split(F.coalesce("tag_string_copyright", F.lit("")), r"(?U)\s+"), lambda t: t != "")).alias("name"))
    records = catalog.numbered(each.groupBy("name").agg(F.count(F.lit(1)).alias("post_count")), "name")
    rows = dictionary.upsert(words(spark, sf), records.select("name", F.lit(3).alias("category"), "post_count", F.col("position").alias("seq")))
    return rows.select("tag", "line_no", "category", "post_count", "aliases")


@query(r"""SELECT doc_id, i - 1 AS pos, lower(replace(regexp_replace(l[i], '^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$', '', 'g'), ' ', '_')) AS link FROM (
 SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1) AS l FROM documents WHERE text IS NOT NULL))""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.wiki_links(table(spark, sf, "documents"), "doc_id", "text")


def sql_profiles(where: str = "true", most: int = 40, posts: str = "posts") -> str:
    lists = " UNION ALL ".join(f"SELECT seed_tag, post_id, {k} AS category, list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS}+'), lambda t: t <> '') AS l FROM p" for k, c in ((4, "tag_string_character"), (3, "tag_string_copyright"), (0, "tag_string_general"), (-1, "tag_string")))
    noise = ", ".join(f"'{t}'" for t in profile.NOISE_TAGS)
    return f"""WITH p AS (SELECT seed_tag, post_id, r.g AS tag_string_general, r.c AS tag_string_character, r.y AS tag_string_copyright, r.t AS tag_string FROM (SELECT seed_tag, post_id,
  arg_max(struct_pack(g := tag_string_general, c := tag_string_character, y := tag_string_copyright, t := tag_string), fetched_at) AS r FROM {posts} WHERE {where} GROUP BY 1, 2)),
 l AS ({lists}), s AS (SELECT seed_tag, max(CASE WHEN category >= 0 AND len(l) > 0 THEN 1 ELSE 0 END) AS new_style FROM l GROUP BY 1),
 e AS (SELECT seed_tag, post_id, category, l, unnest(range(1, len(l) + 1)) AS i FROM l),
 t AS (SELECT e.seed_tag, greatest(category, 0) AS category, l[i] AS raw_tag, count(*) AS n, min(struct_pack(post_id, i)) AS first FROM e JOIN s USING (seed_tag)
  WHERE (category >= 0 AND new_style = 1) OR (category = -1 AND new_style = 0) GROUP BY 1, 2, 3),
 q AS (SELECT seed_tag, count(*) AS posts FROM p GROUP BY 1),
 f AS (SELECT t.*, n / posts AS share, CASE category WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS prio FROM t JOIN q USING (seed_tag)),
 o AS (SELECT *, row_number() OVER (PARTITION BY seed_tag, raw_tag ORDER BY prio) AS k FROM f WHERE share >= 0.08 AND NOT (category = 0 AND replace(raw_tag, '_', ' ') IN ({noise}))),
 r AS (SELECT *, row_number() OVER (PARTITION BY seed_tag ORDER BY prio, n DESC, first) AS place FROM o WHERE k = 1)
 SELECT seed_tag, place, replace(raw_tag, '_', ' ') AS tag, raw_tag, n AS count, round(share, 3) AS frequency, category, CASE category WHEN 4 THEN 'character' WHEN 3 THEN 'copyright' ELSE 'general' END AS category_name FROM r WHERE place <= {most}"""


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profiles(profile.latest_posts(table(spark, sf, "posts")))


@query(sql_profiles())
def tag_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every seed at once."""
    return _profiles(spark, sf)


@query(f"SELECT place, tag, count FROM ({sql_profiles(f'seed_tag = {SEED!r}')}) WHERE lower(tag) NOT IN ('plain backdrop', 'jade_hair')")
def tag_profile_new(spark: SparkSession, sf: str) -> DataFrame:
    """One seed's profile without the tags the prompt has."""
    posts = profile.latest_posts(table(spark, sf, "posts").where(F.col("seed_tag") == SEED))
    return profile.without_present(profile.profiles(posts), "Plain Backdrop, jade_hair").select("place", "tag", "count")


@query(f"SELECT seed_tag, category, list(tag ORDER BY place) AS tags FROM ({sql_profiles()}) GROUP BY 1, 2")
def tag_profile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return profile.buckets(_profiles(spark, sf))


_FORM = f"replace(lower({sql_strip('t')}), '_', ' ')"


@query(
    f"""SELECT id, coalesce(string_agg(t, ', ' ORDER BY i), '') AS deduped FROM (SELECT id, t, i, row_number() OVER (PARTITION BY id, {_FORM} ORDER BY i) AS k FROM
 (SELECT id, l[i] AS t, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, {sql_commas('tags')} AS l FROM characters))) WHERE {_FORM} <> '') WHERE k = 1 GROUP BY id"""
)
def taglist_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "characters").select("id", taglist.unique(T.comma_tags("tags")).alias("u"))
    return rows.select("id", F.array_join("u", ", ").alias("deduped"), F.size("u").alias("n")).where("n > 0").drop("n")


@query(
    f"""SELECT id, list_concat(have, CASE WHEN danbooru_tag IS NULL OR {sql_strip('danbooru_tag')} = '' OR list_contains(list_transform(have, lambda t: {_FORM}), replace(lower({sql_strip('danbooru_tag')}), '_', ' '))
 THEN [] ELSE [danbooru_tag] END) AS tags FROM (SELECT id, {sql_commas('tags')} AS have, danbooru_tag FROM characters)"""
)
def taglist_append(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical tag of each row appended to its list where it is new."""
    new = F.when(F.col("danbooru_tag").isNull(), F.array().cast("array<string>")).otherwise(F.array("danbooru_tag"))
    return table(spark, sf, "characters").select("id", taglist.append_unique(T.comma_tags("tags"), new).alias("tags"))


@query(
    f"""WITH e AS (SELECT id, l[i] AS t, i FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, {sql_commas('tags')} AS l FROM characters))),
 k AS (SELECT replace(lower({sql_strip('tag')}), '_', ' ') AS k, max(category) AS category FROM danbooru_tags GROUP BY 1),
 r AS (SELECT id, t, i, CASE WHEN regexp_full_match(t, '[1-6]\\+?(girl|boy)s?', 'i') AND contains(lower(t), 'boy') THEN 0 WHEN regexp_full_match(t, '[1-6]\\+?(girl|boy)s?', 'i') THEN 1
  WHEN category = 4 THEN 2 WHEN category = 3 THEN 3 ELSE 4 END AS c FROM e LEFT JOIN k ON k.k = {_FORM})
 SELECT id, string_agg(t, ', ' ORDER BY c, i) AS ordered FROM r GROUP BY id"""
)
def taglist_category_order(spark: SparkSession, sf: str) -> DataFrame:
    lookup = table(spark, sf, "danbooru_tags").select("tag", "category")
    return taglist.in_class_order(table(spark, sf, "characters"), "id", "tags", lookup)


@query(f"SELECT id, {sql_strip(chr(99) + 'oalesce(nullif(tags, ' + repr('') + '), nullif(danbooru_tag, ' + repr('') + '), ' + repr('') + ')')} AS base, concat_ws(', ', nullif({sql_strip('coalesce(danbooru_tag, ' + repr('') + ')')}, ''), nullif(series, '')) AS raw FROM characters")
def taglist_prompt_base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "characters").select("id", taglist.prompt_base("tags", "danbooru_tag").alias("base"), taglist.append_raw("danbooru_tag", "series").alias("raw"))


@query(
    f"""SELECT id, substr(regexp_replace(lower(replace({sql_strip("coalesce(name, '')")}, ' ', '_')), '[^a-z0-9_-]', '', 'g'), 1, 50) AS file, lower(replace({sql_strip("coalesce(name, '')")}, ' ', '_')) AS query,
 replace(lower({sql_strip('name')}), '_', ' ') AS compare, trim(regexp_replace(name, '{WS}+', ' ', 'g')) AS squeezed FROM characters"""
)
def name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "characters").select("id", T.file_name("name").alias("file"), T.query_form("name").alias("query"), T.compare_form("name").alias("compare"), T.squeeze("name").alias("squeezed"))


@query(
    f"""SELECT id, coalesce(list_sort(list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(name), '[_()\\\\]', ' ', 'g'), '{WS}+')), lambda w: w <> '' AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOP_WORDS)}], w))), []) AS words
 FROM characters WHERE name IS NOT NULL"""
)
def name_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "characters").where(F.col("name").isNotNull()).select("id", F.sort_array(T.meaningful_words("name")).alias("words"))


_UNESC = sql_strip(r"replace(replace(name, '\(', '('), '\)', ')')")
_BASE = sql_strip(f"regexp_replace(n, '{WS}*\\([^)]+\\){WS}*$', '')")


@query(
    f"""SELECT id, n AS plain, b AS base, regexp_extract(n, '\\(([^)]+)\\){WS}*$', 1) AS suffix, CASE WHEN len(w) = 2 AND NOT contains(b, '(') THEN w[2] || ' ' || w[1] ELSE '' END AS inverted FROM
 (SELECT *, list_filter(regexp_split_to_array(b, '{WS}+'), lambda x: x <> '') AS w FROM (SELECT *, {_BASE} AS b FROM (SELECT id, {_UNESC} AS n FROM characters WHERE name IS NOT NULL)))"""
)
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "characters").where(F.col("name").isNotNull()).select("id", T.unescape_brackets("name").alias("plain"))
    return rows.select("id", "plain", T.without_suffix("plain").alias("base"), T.suffix("plain").alias("suffix")).withColumn("inverted", T.inverted("base"))


_MEDIA = ", ".join(f"'{m}'" for m in cleaning.MEDIA)


@query(
    f"""WITH a AS (SELECT id, name, CASE WHEN coalesce(series, '') = '' AND coalesce(tags, '') <> '' AND len(string_split(tags, ',')) >= 2 THEN {sql_title(sql_strip("string_split(tags, ',')[2]"))} ELSE series END AS s FROM characters),
 b AS (SELECT *, replace(s, '\\', '') AS sc, replace(name, '\\', '') AS nc FROM a), c AS (SELECT *, regexp_extract_all(sc, '\\(([^)]+)\\)', 1) AS g, {sql_title(sql_strip(f"regexp_replace(nc, '{WS}*\\([^)]+\\)', '', 'g')"))} AS base FROM b),
 d AS (SELECT *, CASE WHEN len(g) >= 2 THEN base || ' (' || {sql_title('g[-2]')} || ')' ELSE base END AS m FROM c), e AS (SELECT *, CASE WHEN length(m) < 2 THEN name ELSE m END AS m2 FROM d)
 SELECT id, CASE WHEN coalesce(s, '') = '' OR len(g) = 0 THEN name WHEN contains(m2, ')') AND NOT contains(m2, '(') THEN replace(m2, ')', '') ELSE m2 END AS new_name,
 CASE WHEN coalesce(s, '') = '' THEN s WHEN len(g) = 0 THEN {sql_title(sql_strip('s'))} WHEN lower({sql_strip('g[-1]')}) IN ({_MEDIA}) THEN {sql_title(sql_strip("string_split(sc, '(')[1]"))} ELSE {sql_title('g[-1]')} END AS new_series FROM e"""
)
def series_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_series(table(spark, sf, "characters").select("id", "name", "series", "tags")).select("id", "new_name", "new_series")


_VALID = "SELECT lower(replace(tag, '_', ' ')) AS t, max(post_count) AS n FROM danbooru_tags GROUP BY 1"
_REPAIR = f"""WITH d AS (SELECT tag, arg_max(post_count, line_no) AS post_count FROM danbooru_tags GROUP BY 1), v AS (SELECT lower(replace(tag, '_', ' ')) AS t, max(coalesce(post_count, 0)) AS n FROM d GROUP BY 1),
 x AS (SELECT t, n, unnest(range(3, length(t))) AS k FROM v WHERE n >= 500 AND length(t) > 3),
 p AS (SELECT substr(t, 1, k) AS partial, max(struct_pack(edge := CAST(substr(t, k + 1, 1) IN (' ', '(', ')') AS INTEGER), n := n, t := t)).t AS completion FROM x GROUP BY 1),
 r AS (SELECT id, tags, regexp_replace(tags, '{WS}+$', '') AS rt FROM characters), s AS (SELECT *, list_transform(string_split(rt, ','), lambda y: {sql_strip('y')}) AS parts FROM r), u AS (SELECT *, lower(parts[-1]) AS last FROM s),
 a AS (SELECT u.*, p.completion, CASE WHEN coalesce(tags, '') = '' THEN 'ok' WHEN ends_with(rt, ',') THEN 'strip_comma' WHEN v.t IS NOT NULL THEN 'ok' WHEN p.completion IS NOT NULL THEN 'completed' WHEN length(last) >= 3 THEN 'ok' ELSE 'removed' END AS action
  FROM u LEFT JOIN v ON v.t = u.last LEFT JOIN p ON p.partial = u.last)
 SELECT id, CASE action WHEN 'strip_comma' THEN regexp_replace(regexp_replace(rt, ',+$', ''), '{WS}+$', '') WHEN 'completed' THEN array_to_string(list_append(parts[:-2], completion), ', ')
 WHEN 'removed' THEN array_to_string(parts[:-2], ', ') ELSE tags END AS fixed, action FROM a"""


@query(_REPAIR)
def tags_repair(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.repair_tags(table(spark, sf, "characters"), words(spark, sf)).select("id", "fixed", "action")


@query(f"SELECT action, count(*) AS n FROM ({_REPAIR}) GROUP BY action")
def tags_repair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tags_repair(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT r.id, r.fixed AS tags FROM ({_REPAIR}) r JOIN characters c ON c.id = r.id WHERE r.fixed IS DISTINCT FROM c.tags")
def tags_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Only the rows that a repair would write (a dry run)."""
    before = table(spark, sf, "characters").select("id", "tags")
    return catalog.changed_only(before, tags_repair(spark, sf).select("id", F.col("fixed").alias("tags")), ["tags"])


_QF = "lower(replace({}, ' ', '_'))"
_KEYS = f"""SELECT id, u.prio, u.label, u.key FROM (SELECT *, unnest([
 {{'prio': 0, 'label': 'full', 'key': {_QF.format('n')}}}, {{'prio': 1, 'label': 'inverted', 'key': {_QF.format('i')}}}, {{'prio': 2, 'label': 'base', 'key': CASE WHEN b <> n THEN {_QF.format('b')} END}},
 {{'prio': 3, 'label': 'series_alias', 'key': CASE WHEN b <> n AND s <> '' THEN {_QF.format('b')} || '_(' || y || ')' END}},
 {{'prio': 4, 'label': 'series_alias_inv', 'key': CASE WHEN b <> n AND s <> '' AND i <> '' THEN {_QF.format('i')} || '_(' || y || ')' END}}]) AS u FROM
 (SELECT q.*, coalesce(t.c, lower(replace({sql_strip('s')}, ' ', '_'))) AS y FROM (SELECT id, plain AS n, base AS b, suffix AS s, inverted AS i FROM ({ORACLES['name_parts']})) q
  LEFT JOIN (SELECT antecedent_name AS a, min(consequent_name) AS c FROM tag_aliases GROUP BY 1) t ON t.a = lower(replace({sql_strip('s')}, ' ', '_')))) WHERE u.key <> ''"""
_BY_DICT = f"(SELECT id, min(struct_pack(prio, label, canonical)) AS h FROM ({_KEYS}) k JOIN ({ORACLES['dict_alias_index']}) x ON x.key = k.key GROUP BY id)"
_SEEDS = f"""SELECT seed_tag AS seed, l[i] AS raw_tag, count(*) AS n, min(struct_pack(post_id, i)) AS first FROM (SELECT seed_tag, post_id, l, unnest(range(1, len(l) + 1)) AS i FROM
 (SELECT seed_tag, post_id, list_filter(regexp_split_to_array(coalesce(t, ''), '{WS}+'), lambda x: x <> '') AS l FROM (SELECT seed_tag, post_id, arg_max(struct_pack(t := tag_string_character), fetched_at).t AS t FROM posts GROUP BY 1, 2))) GROUP BY 1, 2"""
_SHORT = ", ".join(f"'{w}'" for w in T.STOP_WORDS_SHORT)


def sql_words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower({x}), '[_()\\\\]', ' ', 'g'), '{WS}+')), lambda w: w <> '' AND NOT list_contains([{_SHORT}], w))"


_RESOLVED = f"""WITH keys AS ({_KEYS}), idx AS ({ORACLES['dict_alias_index']}), dic AS (SELECT id, min(struct_pack(prio, label, canonical)) AS h FROM keys JOIN idx USING (key) GROUP BY id),
 seeds AS ({_SEEDS}), nm AS (SELECT id, {sql_words('plain')} AS w FROM ({ORACLES['name_parts']})),
 fit AS (SELECT k.id, prio, label, raw_tag, n, first FROM keys k JOIN seeds s ON s.seed = k.key JOIN nm USING (id) WHERE list_has_any({sql_words('raw_tag')}, w)),
 best AS (SELECT id, prio, label, arg_min(raw_tag, struct_pack(a := -n, first)) AS raw_tag FROM fit GROUP BY 1, 2, 3),
 post AS (SELECT id, min(struct_pack(prio, label, canonical)) AS h FROM best JOIN idx ON idx.key = best.raw_tag GROUP BY id),
 q AS (SELECT * FROM keys WHERE id NOT IN (SELECT id FROM dic) AND id NOT IN (SELECT id FROM post)),
 cand AS (SELECT key, tag, post_count FROM (SELECT q.key, d.tag, d.post_count, row_number() OVER (PARTITION BY q.key ORDER BY d.post_count DESC, d.tag) AS k
  FROM (SELECT DISTINCT key FROM q) q JOIN {DICT} d ON d.category = 4 AND contains(lower(d.tag), q.key)) WHERE k <= 20),
 own AS (SELECT id, {sql_words('plain')} AS w, {sql_words('suffix')} AS sw, {sql_words('base')} AS bw FROM ({ORACLES['name_parts']})),
 sc AS (SELECT q.id, prio, label, tag, post_count, len(list_intersect({sql_words('tag')}, w)) AS overlap, sw, {sql_words(f"regexp_extract(tag, '\\(([^)]+)\\){WS}*$', 1)")} AS csw
  FROM q JOIN cand ON cand.key = q.key JOIN own ON own.id = q.id WHERE NOT (label = 'base' AND len(sw) > 0 AND len(bw) < 2)),
 srt AS (SELECT id, prio, label, arg_max(tag, struct_pack(overlap, post_count, tag)) AS tag FROM sc WHERE overlap > 0 AND (len(sw) = 0 OR len(csw) = 0 OR list_has_any(sw, csw)) GROUP BY 1, 2, 3),
 sea AS (SELECT id, min(struct_pack(prio, label, canonical)) AS h FROM srt JOIN idx ON idx.key = lower(srt.tag) GROUP BY id)
 SELECT c.id, CASE WHEN dic.h IS NOT NULL THEN replace(dic.h.canonical, '_', ' ') WHEN post.h IS NOT NULL THEN replace(post.h.canonical, '_', ' ') WHEN sea.h IS NOT NULL THEN replace(sea.h.canonical, '_', ' ') ELSE '' END AS tag,
 CASE WHEN dic.h IS NOT NULL THEN 'csv:' || dic.h.label WHEN post.h IS NOT NULL THEN post.h.label WHEN sea.h IS NOT NULL THEN 'tag_search:' || sea.h.label ELSE 'not_found' END AS strategy
 FROM characters c LEFT JOIN dic ON dic.id = c.id LEFT JOIN post ON post.id = c.id LEFT JOIN sea ON sea.id = c.id"""


@query(_RESOLVED)
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the catalog by the dictionary, then by the character tags of their posts, then by a search for tags."""
    return _resolved(spark, sf, ("dictionary", "posts", "search"))


def _resolved(spark: SparkSession, sf: str, stages: tuple[str, ...]) -> DataFrame:
    names = table(spark, sf, "characters").select("id", "name")
    index = dictionary.alias_index(words(spark, sf))
    keyed = written(resolve.keys(names, table(spark, sf, "tag_aliases")))
    posts = profile.latest_posts(table(spark, sf, "posts"))
    each = posts.select("seed_tag", "post_id", F.posexplode(F.filter(F.split(F.coalesce("tag_string_character", F.lit("")), r"(?U)\s+"), lambda t: t != "")).alias("pos", "raw_tag"))
    seeds = each.groupBy(F.col("seed_tag").alias("seed"), "raw_tag").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("post_id", "pos")).alias("first"))
    tags = words(spark, sf).where(F.col("category") == 4).select("tag", "post_count")
    made = {
        "dictionary": lambda k: resolve.by_dictionary(k, index),
        "direct": lambda k: resolve.by_dictionary(k.where(F.col("prio") < 3), index),
        "posts": lambda k: resolve.by_posts(names, k, seeds, index),
        "search": lambda k: resolve.by_tag_search(names, k, tags, index),
    }
    return resolve.cascade(names, keyed, [made[s] for s in stages])


@query(f"SELECT c.id, coalesce(replace(h.canonical, '_', ' '), '') AS tag, coalesce('csv:' || h.label, 'not_found') AS strategy FROM characters c LEFT JOIN (SELECT id, min(struct_pack(prio, label, canonical)) AS h FROM ({_KEYS}) k JOIN ({ORACLES['dict_alias_index']}) x ON x.key = k.key WHERE prio < 3 GROUP BY id) d ON d.id = c.id")
def resolve_dictionary_only(spark: SparkSession, sf: str) -> DataFrame:
    """Names by the dictionary alone, without the keys that need the series' canonical name."""
    return _resolved(spark, sf, ("direct",))


@query(_RESOLVED.replace("JOIN idx USING (key) GROUP BY id)", "JOIN idx USING (key) WHERE false GROUP BY id)", 1))
def resolve_without_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Names by posts and tag search alone; what they give is still written as the dictionary has it."""
    return _resolved(spark, sf, ("posts", "search"))


@query(f"SELECT strategy, count(*) AS n, CAST(starts_with(strategy, 'csv:') AS INTEGER) AS from_dictionary FROM ({_RESOLVED}) GROUP BY strategy")
def resolve_strategy_stats(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.strategy_counts(resolve_cascade(spark, sf))


@query(
    f"""SELECT name, 'a series' AS series,
 regexp_replace(name, '{WS}+', ' ', 'g') || ', a series, 1girl' AS tags, 'https://listing.example/p/x.jpg' AS image_url, rank + 48 AS rank, 'e621' AS source
 FROM (SELECT trim(regexp_replace(name, '[ \\t]+', ' ', 'g')) AS name, row_number() OVER (ORDER BY tag) AS rank FROM (SELECT DISTINCT tag, replace(tag, '_', ' ') AS name FROM danbooru_tags WHERE category = 4 AND NOT contains(tag, ',')))"""
)
def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages made from the dictionary's characters, read back as records."""
    tags = table(spark, sf, "danbooru_tags").where((F.col("category") == 4) & ~F.contains("tag", F.lit(","))).select("tag").distinct()  # a comma list cannot hold one
    each = catalog.numbered(tags, "tag").withColumn("page", F.expr("position div 24 + 1"))
    card = F.concat(F.lit('<div class="card"><div class="card-header"><span>'), T.display_form("tag"), F.lit('</span></div><img alt="thumbnail" src="p/x.jpg"><div class="card-body"><div class="alert alert-secondary">'), T.display_form("tag"), F.lit(", a series, 1girl</div></div></div>"))
    pages = each.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", card.alias("c")))), lambda x: x["c"]), "").alias("html"))
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.write.partitionBy("page").text(folder)
    read = spark.read.text(f"{folder}/page=*", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"page=(\d+)", 1).cast("long").alias("page"), F.col("value").alias("html"))
    return cards.extract_cards(read, "https://listing.example/", 48, "e621")


_HISTORY = f"SELECT user_id, place, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY used DESC) AS place FROM (SELECT user_id, {{}} AS item, max(struct_pack(ts, action_id)) AS used FROM {ONCE} WHERE {{}} GROUP BY 1, 2)) WHERE place <= {{}}"
_SEARCHES = _HISTORY.format(sql_strip("typed"), f"act = 'search' AND {sql_strip('typed')} <> ''", 20)


@query(_SEARCHES)
def history_mru(spark: SparkSession, sf: str) -> DataFrame:
    return state.search_history(table(spark, sf, "actions"))


@query(_HISTORY.format("char_id", "act = 'view' AND char_id IS NOT NULL", 100))
def recent_mru(spark: SparkSession, sf: str) -> DataFrame:
    return state.recently_viewed(table(spark, sf, "actions"))


@query(f"SELECT user_id, char_id FROM {_FAVORITES}")
def favorites_toggle(spark: SparkSession, sf: str) -> DataFrame:
    return state.favorites(table(spark, sf, "actions"))


@query(f"SELECT user_id, CAST(to_json(list(char_id ORDER BY char_id)) AS VARCHAR) AS value FROM {_FAVORITES} GROUP BY user_id")
def favorites_json(spark: SparkSession, sf: str) -> DataFrame:
    return writers.favorites_json(state.favorites(table(spark, sf, "actions")))


@query(f"SELECT user_id, CAST(to_json(list(item ORDER BY place)) AS VARCHAR) AS value FROM ({_SEARCHES}) GROUP BY user_id")
def history_json(spark: SparkSession, sf: str) -> DataFrame:
    return writers.ordered_json(state.search_history(table(spark, sf, "actions")))


@query("SELECT item FROM (SELECT char_id AS item, max(struct_pack(ts, action_id)) AS used FROM actions WHERE char_id IS NOT NULL GROUP BY 1) ORDER BY used DESC LIMIT 500")
def image_cache_lru(spark: SparkSession, sf: str) -> DataFrame:
    return state.cached_items(table(spark, sf, "actions"))


@query(
    """WITH RECURSIVE q AS (SELECT seed_tag AS k, fetched_at AS t FROM posts WHERE seed_tag IS NOT NULL AND fetched_at IS NOT NULL),
 f AS (SELECT k, min(t) AS t FROM q GROUP BY k UNION ALL SELECT f.k, min(q.t) FROM f JOIN q ON q.k = f.k AND q.t >= f.t + INTERVAL 1800 SECOND GROUP BY f.k)
 SELECT k AS key, requests, requests - fetches AS hits FROM (SELECT k, count(*) AS requests FROM q GROUP BY k) JOIN (SELECT k, count(*) AS fetches FROM f GROUP BY k) USING (k)"""
)
def post_cache_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of every seed that a cached answer could serve."""
    return state.cache_use(table(spark, sf, "posts"), "seed_tag", "fetched_at").groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query(f"SELECT user_id, char_id FROM {_FAVORITES}")
def stream_favorites(spark: SparkSession, sf: str) -> DataFrame:
    """The favorites as a streaming query, read to the end of the log."""
    out = stream.run_to_end(stream.favorite_counts(stream.by_receipt(stream.read_log(spark, f"{sf}/actions.parquet*", bytes_a_batch=stream.BATCH_BYTES))), "favorites", "update", checked=False)
    last = out.groupBy("user_id", "char_id").agg(F.max_by("n", "batch").alias("n"))
    return last.where(F.col("n") % 2 == 1).select("user_id", "char_id")


@query(_SEARCHES)
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """The search histories as a streaming query; the last state of each user."""
    out = stream.run_to_end(stream.search_histories(stream.deduplicated(stream.by_receipt(stream.read_log(spark, f"{sf}/actions.parquet*", bytes_a_batch=stream.BATCH_BYTES)))), "history", "update", checked=False)
    last = out.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["user_id", "batch"]).select("user_id", F.col("place").cast("int").alias("place"), "item")


@query(f"SELECT * FROM {CATALOG} WHERE {_BOTH} ORDER BY rank ASC NULLS FIRST, id LIMIT 7 OFFSET (SELECT (greatest(1, (count(*) + 6) // 7) - 1) * 7 FROM {CATALOG} WHERE {_BOTH})")
def page_jump(spark: SparkSession, sf: str) -> DataFrame:
    """A jump beyond the end shows the last page."""
    return catalog.page_at(catalog.search(cat(spark, sf), "mothmark, hair"), "9e9", 7)


@query(f"SELECT * FROM {CATALOG} WHERE {_BOTH} ORDER BY rank ASC NULLS FIRST, id LIMIT 30")
def page_jump_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """A page number and a page size that cannot be read give the first page of thirty."""
    return catalog.page_at(catalog.search(cat(spark, sf), "mothmark, hair"), "next", "many")


@query(f"SELECT * FROM (SELECT * FROM {CATALOG} WHERE {_BOTH} ORDER BY rank ASC NULLS FIRST, id LIMIT 1) UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
def page_row_at(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of a page, and the empty card for an index out of range."""
    rows = catalog.page(catalog.search(cat(spark, sf), "mothmark, hair"))
    return catalog.row_at(rows, 0).unionByName(catalog.row_at(rows, 1000))


@query("SELECT count(*) > 0 AS populated, false AS missing FROM characters")
def catalog_is_populated(spark: SparkSession, sf: str) -> DataFrame:
    there, missing = catalog.is_populated(spark, f"{sf}/characters.parquet"), catalog.is_populated(spark, f"{sf}/no_such_catalog.parquet")
    return spark.range(1).select(F.lit(there).alias("populated"), F.lit(missing).alias("missing"))


_VIEWS = _HISTORY.format("char_id", "act = 'view' AND char_id IS NOT NULL", 100)


@query(f"SELECT v.user_id, greatest(1, least(2, pages)) AS page, place, item FROM ({_VIEWS}) v JOIN (SELECT user_id, CAST((max(place) + 29) // 30 AS INTEGER) AS pages FROM ({_VIEWS}) GROUP BY 1) p USING (user_id) WHERE (place - 1) // 30 = greatest(1, least(2, pages)) - 1")
def recent_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of what each user viewed, the first where there is no second."""
    return state.recent_pages(state.recently_viewed(table(spark, sf, "actions")), 2)


@query(
    f"""SELECT user_id, CAST(to_json(list(struct_pack(id := item, name := coalesce(name, ''), series := coalesce(series, ''), tags := coalesce(tags, ''), danbooru_tag := coalesce(danbooru_tag, ''),
 image_url := coalesce(image_url, ''), source := coalesce(source, 'danbooru')) ORDER BY place)) AS VARCHAR) AS value FROM ({_VIEWS}) v LEFT JOIN characters c ON c.id = v.item GROUP BY user_id"""
)
def recent_json(spark: SparkSession, sf: str) -> DataFrame:
    """What each user viewed as a JSON array of records."""
    return writers.recents_json(state.recently_viewed(table(spark, sf, "actions")), table(spark, sf, "characters"))


@query(f"SELECT * FROM ({_VIEWS}) WHERE user_id NOT IN (SELECT user_id FROM {_FAVORITES} WHERE user_id IS NOT NULL)")
def recent_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the lists when users with favorites clear theirs."""
    actions = table(spark, sf, "actions")
    return state.cleared(state.recently_viewed(actions), state.favorites(actions))


@query(
    f"""WITH c AS {CATALOG}, s AS (SELECT * FROM c WHERE {_BOTH} ORDER BY rank ASC NULLS FIRST, id LIMIT 30),
 v AS (SELECT * FROM c WHERE id IN (SELECT item FROM ({_VIEWS}))), f AS (SELECT * FROM c WHERE id IN (SELECT char_id FROM {_FAVORITES}))
 SELECT id, min(place) AS place, any_value(name) AS name FROM (SELECT id, 0 AS place, name FROM s UNION ALL SELECT id, 1, name FROM v UNION ALL SELECT id, 2, name FROM f) GROUP BY id"""
)
def find_in_lists(spark: SparkSession, sf: str) -> DataFrame:
    """For every id the first list that has it: the page of results, the viewed, the favorites."""
    rows, actions = cat(spark, sf), table(spark, sf, "actions")
    viewed = catalog.search(rows, ids=state.recently_viewed(actions).select(F.col("item").alias("id")))
    loved = catalog.search(rows, ids=state.favorites(actions).select(F.col("char_id").alias("id")))
    found = state.first_of(rows.select("id"), catalog.page(catalog.search(rows, "mothmark, hair")), viewed, loved)
    return found.select("id", "place", "row.name")


@query("SELECT seed_tag, count(*) AS posts, min(post_id) AS oldest FROM (SELECT seed_tag, post_id, row_number() OVER (PARTITION BY seed_tag ORDER BY post_id DESC) AS k FROM (SELECT DISTINCT seed_tag, post_id FROM posts)) WHERE k <= 120 GROUP BY seed_tag")
def posts_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 120 posts of each seed (the sample that a profile is made of)."""
    kept = profile.sampled_posts(profile.latest_posts(table(spark, sf, "posts")))
    return kept.groupBy("seed_tag").agg(F.count(F.lit(1)).alias("posts"), F.min("post_id").alias("oldest"))


@query(sql_profiles())
def posts_read_json(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of posts landed as JSON records."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    latest = profile.latest_posts(table(spark, sf, "posts"))
    latest.write.json(path)
    read = readers.read_posts(spark, path, "seed_tag string")
    return profile.profiles(read)


@query(f"SELECT user_id, char_id AS item FROM {_FAVORITES}")
def favorites_read_json(spark: SparkSession, sf: str) -> DataFrame:
    """Favorites written as JSON and read back."""
    value = writers.favorites_json(state.favorites(table(spark, sf, "actions")))
    return value.select("user_id", F.explode(readers.parse_id_list("value")).alias("item"))


@query(_SEARCHES)
def history_read_json(spark: SparkSession, sf: str) -> DataFrame:
    """Search histories written as JSON and read back."""
    value = writers.ordered_json(state.search_history(table(spark, sf, "actions")))
    return value.select("user_id", F.posexplode(readers.parse_text_list("value")).alias("place", "item")).withColumn("place", F.col("place") + 1)


@query(f"SELECT CAST(id AS VARCHAR) AS id, tag FROM {_OVERRIDES}")
def overrides_read_json(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides written as JSON objects, one for each thousand ids, and read back."""
    rows = state.overrides(table(spark, sf, "actions"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "danbooru_tag")))
    value = rows.groupBy(F.expr("id div 1000").alias("part")).agg(F.to_json(pairs, {"ignoreNullFields": "false"}).alias("value"))
    return value.select(F.explode(readers.parse_overrides("value")).alias("id", "tag"))


@query(f"SELECT wildcard, max(value) AS value FROM (SELECT substr(regexp_replace(lower(replace({sql_strip('name')}, ' ', '_')), '[^a-z0-9_-]', '', 'g'), 1, 50) AS wildcard, {sql_strip('tags')} AS value FROM characters) WHERE wildcard <> '' AND value <> '' GROUP BY wildcard")
def wildcard_export(spark: SparkSession, sf: str) -> DataFrame:
    """The text files of an export, by name."""
    return writers.wildcard_files(table(spark, sf, "characters"))


_EXTRA_FORM = "replace(lower({}), '_', ' ')"
_EXTRAS = f"""WITH pr AS (SELECT seed_tag, list(struct_pack(t := tag, c := CASE WHEN category IN (4, 3, 0, 1, 5) THEN category ELSE 0 END) ORDER BY place) AS l FROM ({sql_profiles(most=60, posts="(SELECT * FROM posts WHERE (seed_tag, post_id) IN (SELECT (seed_tag, post_id) FROM (SELECT seed_tag, post_id, row_number() OVER (PARTITION BY seed_tag ORDER BY post_id DESC) AS k FROM (SELECT DISTINCT seed_tag, post_id FROM posts)) WHERE k <= 120))")}) GROUP BY 1),
 e AS (SELECT id, {sql_strip("coalesce(nullif(danbooru_tag, ''), name, '')")} AS seed, coalesce(series, '') AS series, tags AS prompt FROM characters),
 j AS (SELECT e.*, l, {_EXTRA_FORM.format(sql_strip('seed'))} AS sf, {_EXTRA_FORM.format(sql_strip('series'))} AS yf, regexp_split_to_array(lower({sql_strip("coalesce(prompt, '')")}), ',{WS}*') AS have FROM e JOIN pr ON pr.seed_tag = lower(replace(seed, ' ', '_')) WHERE seed <> ''),
 k AS (SELECT *, list_filter(l, lambda x: {_EXTRA_FORM.format(sql_strip('x.t'))} <> '' AND NOT list_contains(have, {_EXTRA_FORM.format(sql_strip('x.t'))})) AS new FROM j),
 m AS (SELECT *, list_transform(new, lambda x: {_EXTRA_FORM.format(sql_strip('x.t'))}) AS known FROM k),
 o AS (SELECT *, NOT list_contains(known, sf) AND NOT list_contains(have, sf) AS s FROM m),
 p AS (SELECT *, series <> '' AND NOT list_contains(known, yf) AND NOT list_contains(have, yf) AND NOT (s AND yf = sf) AS y FROM o),
 g AS (SELECT id, prompt, list_concat(CASE WHEN s THEN [struct_pack(t := seed, c := 4)] ELSE [] END, CASE WHEN y THEN [struct_pack(t := series, c := 3)] ELSE [] END, new) AS every FROM p),
 x AS (SELECT id, prompt, every, unnest(range(1, len(every) + 1)) AS i FROM g),
 u AS (SELECT id, every[i].t AS t, every[i].c AS c, i, row_number() OVER (PARTITION BY id, every[i].c, {_EXTRA_FORM.format(sql_strip('every[i].t'))} ORDER BY i) AS r FROM x)"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "characters")
    return rows.select("id", T.or_default("danbooru_tag", F.coalesce("name", F.lit(""))).alias("seed"), "series", F.col("tags").alias("prompt"))


def _extras(spark: SparkSession, sf: str) -> DataFrame:
    posts = profile.sampled_posts(profile.latest_posts(table(spark, sf, "posts")))
    return extras.fetch(_entries(spark, sf), extras.profile_lists(profile.profiles(posts, most=60)))


@query(
    _EXTRAS
    + " SELECT g.id, "
    + ", ".join(f"coalesce(list(t ORDER BY i) FILTER (c = {k} AND r = 1), []) AS c{k}" for k in extras.CLASSES)
    + ", count(*) FILTER (r = 1) AS total FROM g LEFT JOIN u ON u.id = g.id GROUP BY g.id"
)
def extras_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Extra tags of every entry by class, and their number: its seed's profile without what its prompt has, seed and series in front."""
    return _extras(spark, sf).select("id", *[f"c{k}" for k in extras.CLASSES], "total")


@query(
    _EXTRAS
    + f""", w AS (SELECT id, 0 AS part, 0 AS k, i, l[i] AS t FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, {sql_commas('prompt')} AS l FROM g)) UNION ALL
  SELECT id, 1, CASE c WHEN 4 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END, i, t FROM u WHERE r = 1),
 z AS (SELECT *, {_FORM} AS f, row_number() OVER (PARTITION BY id, {_FORM} ORDER BY part, k, i) AS nth FROM w),
 q AS (SELECT id, part, k, i, t, f FROM z WHERE part = 0 OR nth = 1), cm AS (SELECT id, {_EXTRA_FORM.format(sql_strip('t'))} AS f, arg_max(c, i) AS c FROM u GROUP BY 1, 2),
 rk AS (SELECT q.id, q.part, q.k, q.i, q.t, CASE WHEN regexp_full_match(t, '[1-6]\\+?(girl|boy)s?', 'i') AND contains(lower(t), 'boy') THEN 0 WHEN regexp_full_match(t, '[1-6]\\+?(girl|boy)s?', 'i') THEN 1
  WHEN cm.c = 4 THEN 2 WHEN cm.c = 3 THEN 3 ELSE 4 END AS cl FROM q LEFT JOIN cm ON cm.id = q.id AND cm.f = q.f),
 d AS (SELECT id, count(*) AS total FROM u GROUP BY id)
 SELECT g.id, CASE WHEN coalesce(d.total, 0) = 0 THEN any_value(g.prompt) ELSE coalesce(string_agg(rk.t, ', ' ORDER BY cl, rk.part, rk.k, rk.i), '') END AS prompt, count(*) FILTER (rk.part = 1) AS added
 FROM g LEFT JOIN rk ON rk.id = g.id LEFT JOIN d ON d.id = g.id GROUP BY g.id, d.total"""
)
def extras_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every entry with all its extra tags, in class order, and how many were added."""
    return extras.apply_selected(_extras(spark, sf))
