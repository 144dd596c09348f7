"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_text, licenses, mixing, periodic, quality, search, set_join, sharding, simhash, token_counts, url_filter
from .common import read_table, shared_path

N_SHARDS = 24
#: Tokenizer versions of the counts.
TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 100, with its whole text, against all documents."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("findings", lambda f: f["confirmed"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))), ",").alias("families"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.assign(read_table(spark, sf_dir, "documents"), N_SHARDS, path=shared_path(spark, "slot-maps"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents for two tokenizer versions, kept up through batches.

    The first batch inserts every document, and second copies of some under
    ids beyond all of the table's (none where no such id is left).  The second deletes the copies and revises documents with
    unique ids to the text that they have.  It is committed twice, and counts
    once, so the totals are those of the table.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    vocabularies = {name: token_counts.load_vocabulary(name) for name in TOKENIZERS}
    rollup = token_counts.Rollup(spark, shared_path(spark, "token-rollup"), vocabularies)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    beyond = (high or 0) - (low or 0) + 1
    ids = F.try_add(F.col("doc_id"), F.lit(beyond).cast("long")) if beyond < 1 << 63 else F.lit(None).cast("long")
    copies = docs.where("pmod(doc_id, 20) = 3").withColumn("doc_id", ids).where("doc_id IS NOT NULL")
    unique = docs.where("doc_id % 20 = 7").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")
    rollup.commit("load", docs.unionByName(copies).withColumn("op", F.lit(token_counts.INSERT)))
    corrections = copies.withColumn("op", F.lit(token_counts.DELETE)).unionByName(docs.join(unique, "doc_id", "left_semi").withColumn("op", F.lit(token_counts.REVISE)))
    for _ in range(2):
        rollup.commit("corrections", corrections)
    return rollup.totals()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12 looks at: a tenth of the documents repeat some of their words to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    own = words[first : first + period]
    return words[:first] + (own * -(-(n - first) // period))[: n - first]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(read_table(spark, sf_dir, "documents"), planted)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.components(read_table(spark, sf_dir, "documents"), set_join.Measure(3, 9, 10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_search": op2_search,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_set_join": op13_set_join,
}


def _op1_fits(rule: url_filter.Rule) -> str:
    """Whether a rule fits, by comparing texts: the operator's regular expressions have no part in it."""
    if rule.tier:
        host, _, path = rule.name.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
    text = rule.pattern.strip("|")
    if rule.pattern.startswith("||"):
        return f"(starts_with(host || path, '{text}') OR contains(host, '.{text}'))"
    return f"{'ends_with' if rule.pattern.endswith('|') else 'contains'}(host || path, '{text}')"


def _op1_sql() -> str:
    rules = url_filter.HOST_RULES + url_filter.PATTERN_RULES
    ranked = sorted(enumerate(rules), key=lambda x: (-x[1].tier, -len(x[1].name or x[1].pattern), x[0]))
    verdict = " ".join(f"WHEN {_op1_fits(r)} THEN '{r.action}'" for _, r in ranked)
    rule = " ".join(f"WHEN {_op1_fits(r)} THEN " + (f"'{r.name}'" if r.name else "NULL") for _, r in ranked)
    return f"""
WITH split AS (SELECT page_id, substr(url, strpos(url, '://') + 3) AS rest FROM pages WHERE contains(url, '://') UNION ALL SELECT page_id, '' FROM pages WHERE url IS NULL OR NOT contains(url, '://')),
cut AS (SELECT page_id, rest, list_min([x FOR x IN [nullif(strpos(rest, '/'), 0), nullif(strpos(rest, '?'), 0), nullif(strpos(rest, '#'), 0), len(rest) + 1] IF x IS NOT NULL]) AS n FROM split),
parts AS (SELECT page_id, substr(rest, 1, n - 1) AS h, substr(rest, n) AS tail FROM cut),
places AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, split_part(split_part(tail, '?', 1), '#', 1) AS path FROM parts)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM places"""


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, rn, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT rn, i, n, array_to_string(words[i : i + n - 1], ' ') AS win
  FROM w, sizes, unnest(range(1, len(words) - n + 2)) AS t(i) WHERE len(words) >= n),
hits AS (SELECT rn, i, dw.n AS n, item FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
covered AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rn, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM hits) GROUP BY rn)
SELECT doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (rn) LEFT JOIN named USING (rn)"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS ord,
         row_number() OVER () AS rn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2 * source_size AS cap,
         (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - (sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 2 * source_size))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (
  SELECT rn, sum(size) OVER (PARTITION BY source ORDER BY ord, size, rn ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT d.doc_id, d.size, source_size, target,
       CAST((whole + CASE WHEN target - whole * source_size > 0 AND 2 * upto - d.size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN k USING (rn)"""

#: The heaviest slot goes to the lightest shard, again and again.  CRC-32 by its table, byte by byte; the table follows from the polynomial.
OP6_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
             lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) % 8192 AS virtual_slot
  FROM documents, crc),
s AS (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS rk FROM d GROUP BY virtual_slot),
g AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range(24), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS shard
  UNION ALL
  SELECT rk, list_transform(loads, lambda x, j: CASE WHEN j = p THEN x + bytes ELSE x END), virtual_slot, p - 1
  FROM (SELECT *, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS p FROM g JOIN s ON s.rk = g.i + 1)),
placed AS (SELECT d.*, shard FROM d JOIN g ON g.slot = d.virtual_slot)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS DOUBLE) AS grown_shard,
       CAST(virtual_slot AS INTEGER) AS virtual_slot, 1 AS map_version
FROM placed"""

OP11_SQL = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, j, x.a AS l, y.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c, unnest(range(1, c.k)) AS t(j)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : j], ' ') AND x.k = j
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1 : c.k], ' ') AND y.k = c.k - j),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, a, array_to_string(ws[i : i + 1], ' ') AS phrase FROM c, unnest([1, 2]) AS t(i) WHERE k = 3),
kept AS (SELECT * FROM low WHERE NOT (k = 2 AND EXISTS (SELECT 1 FROM inner_ AS o WHERE o.lang = low.lang AND o.phrase = low.phrase AND 100 * o.a >= 50 * low.a)))
SELECT kept.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) AS kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000"""

#: Matches of all words at all lags, islands of them by gaps, and of islands of one place and length the one of the least lag.
OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
t AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
             lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM documents, crc),
s AS (SELECT *, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS edited FROM t),
p AS (SELECT *, CASE WHEN edited THEN g % n ELSE n END AS a, CASE WHEN edited THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM s),
w AS MATERIALIZED (SELECT rn, n, i, CASE WHEN i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS w FROM p, unnest(range(n)) AS u(i)),
m AS (SELECT x.rn, x.i, y.i - x.i AS q FROM w AS x JOIN w AS y ON x.rn = y.rn AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT rn, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rn, q ORDER BY i) AS grp FROM m) GROUP BY rn, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rn, start, length, min(q) AS period FROM isl GROUP BY rn, start, length),
best AS (SELECT rn, count(*) OVER (PARTITION BY rn) AS n_runs, start, length, period FROM runs
         QUALIFY row_number() OVER (PARTITION BY rn ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) = 1),
digest AS (SELECT rn, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY rn),
gone AS (SELECT DISTINCT rn, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT rn, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM w ANTI JOIN gone USING (rn, i) GROUP BY rn)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM t LEFT JOIN best USING (rn) LEFT JOIN digest USING (rn) LEFT JOIN kept USING (rn)"""

OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rn, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') AS s FROM t, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
p AS (SELECT x.rn AS a, y.rn AS b, count(*) AS common FROM s AS x JOIN s AS y ON x.s = y.s AND x.rn <> y.rn GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n AS x ON x.rn = a JOIN n AS y ON y.rn = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT rn AS a, rn AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT x.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN t AS x ON x.rn = reach.a JOIN t AS y ON y.rn = reach.b LEFT JOIN n ON n.rn = x.rn GROUP BY x.rn, x.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _op1_sql(),
    "op4_decontaminate": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_set_join": OP13_SQL,
}
