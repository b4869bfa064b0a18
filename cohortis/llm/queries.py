"""Registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, fingerprints, hard_negatives, html_text, langid, line_dedup, mixing, neardup, packing, pii, secret_scan, url_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


NEAR_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
g AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (WITH RECURSIVE c(id, low) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.id AND c.low < p.b)
  SELECT id, min(low) AS low FROM c GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, r.low AS component_id, s.doc_id = r.low AS kept FROM s JOIN r ON r.id = s.doc_id
"""


@query(NEAR_SQL)
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=3, part=85)


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, folder, "documents"))


@query()
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _urls_sql() -> str:
    """Every pattern on every url, and the host and path rules longest first."""
    tried = ", ".join(
        f"CASE WHEN regexp_matches(lower(url), '{p}') THEN '{n}' END" for n, _, p in sorted(url_rules.PATTERN_RULES)
    )
    sites = sorted(url_rules.SITE_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sites]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " WHEN patterns <> '' THEN 'block' ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  coalesce(array_to_string(list_filter([{tried}], lambda x: x IS NOT NULL), ','), '') AS patterns FROM u)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, patterns FROM p
"""


@query(_urls_sql())
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


# Every window of thirteen tokens with at most two replaced has four equal tokens in a row: these find the places.
DECONTAM_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
tg AS (SELECT id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] AS g FROM (SELECT id, w, unnest(range(0, len(w) - 3)) AS p FROM t)),
bg AS (SELECT id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] AS g FROM (SELECT id, w, unnest(range(0, len(w) - 3)) AS p FROM b)),
d AS MATERIALIZED (SELECT DISTINCT tg.id AS doc_id, bg.id AS item_id, tg.p - bg.p AS shift FROM tg JOIN bg USING (g)),
e AS MATERIALIZED (SELECT doc_id, item_id, shift, q, t.w AS tw, b.w AS bw FROM d JOIN t ON t.id = doc_id JOIN b ON b.id = item_id,
  unnest(range(greatest(0, -shift), least(len(b.w), len(t.w) - shift) - 12)) AS x(q) WHERE len(b.w) >= 13),
f AS (SELECT doc_id, item_id, shift + q AS p, len(list_filter(range(1, 14), lambda i: tw[shift + q + i] = bw[q + i])) AS n FROM e)
SELECT doc_id, item_id, min(p)::BIGINT AS first_token, max(n)::BIGINT AS n_equal FROM f WHERE n >= 11 GROUP BY ALL
"""


@query(DECONTAM_SQL)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Lines of the same length that share a half are compared word by word; one word more or less by all deletions of the pair.
LINES_SQL = r"""
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])',
    ' \1 ', 'g'), '[ \t\r\f]+', ' ', 'g') AS norm FROM documents),
l AS MATERIALIZED (SELECT doc_id, pos, line, string_split(trim(words, ' '), ' ') AS w FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(norm, chr(10))) AS words, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t)),
d AS MATERIALIZED (SELECT w, len(w) AS n, min((doc_id, pos)) AS first FROM l WHERE w <> [''] GROUP BY w),
near AS (
  SELECT a.first FROM d a JOIN d b ON a.n = b.n AND a.w[:a.n // 2] = b.w[:b.n // 2] AND a.n >= 3 AND b.first < a.first
    AND len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) = 1
  UNION SELECT a.first FROM d a JOIN d b ON a.n = b.n AND a.w[a.n // 2 + 1:] = b.w[b.n // 2 + 1:] AND a.n >= 3 AND b.first < a.first
    AND len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) = 1
  UNION SELECT greatest(a.first, b.first) FROM d a JOIN d b ON a.n = b.n + 1 AND a.w[:b.n // 2] = b.w[:b.n // 2] AND b.n >= 3
    AND len(list_filter(range(1, a.n + 1), lambda i: a.w[:i - 1] || a.w[i + 1:] = b.w)) > 0
  UNION SELECT greatest(a.first, b.first) FROM d a JOIN d b ON a.n = b.n + 1 AND a.w[b.n // 2 + 2:] = b.w[b.n // 2 + 1:] AND b.n >= 3
    AND len(list_filter(range(1, a.n + 1), lambda i: a.w[:i - 1] || a.w[i + 1:] = b.w)) > 0),
m AS (SELECT l.doc_id, l.pos, l.line, d.first IS NOT NULL AND (d.first <> (l.doc_id, l.pos) OR d.first IN (SELECT first FROM near)) AS gone
  FROM l LEFT JOIN d ON d.w = l.w)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id
"""


@query(LINES_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def _mixing_sql(epochs: int = mixing.EPOCHS) -> str:
    """Levels filled from the root, leaves by running sums over all their documents."""
    weight = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {w}" for k, w in mixing.WEIGHTS[c].items()) + " ELSE 1.0 END::DOUBLE" if mixing.WEIGHTS[c] else "1.0::DOUBLE"
    parts, above = [], "SELECT least(floor(sum(n_tokens) * %s), sum(n_tokens) * %d)::DOUBLE AS given FROM t" % (mixing.SHARE, epochs)
    for k, level in enumerate(mixing.LEVELS):
        own, up = ", ".join(mixing.LEVELS[: k + 1]), ", ".join(mixing.LEVELS[:k])
        by = f"PARTITION BY {up}" if up else ""
        join = f"JOIN a{k} USING ({up})" if up else f"CROSS JOIN a{k}"
        parts.append(f"""a{k} AS MATERIALIZED ({above}),
c{k} AS (SELECT {own}, sum(n_tokens)::DOUBLE * {epochs} AS cap, {weight(level)} AS w FROM t GROUP BY {own}),
f{k} AS (SELECT *, given - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
  sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM c{k} {join}),
g{k} AS MATERIALIZED (SELECT *, cap * weight <= free * w + 1e-9 AS capped FROM f{k})""")
        above = f"""SELECT {own}, CASE WHEN capped THEN cap ELSE (given - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ({by})) * w
  / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ({by}) END AS given FROM g{k}"""
    leaf = ", ".join(mixing.LEVELS)
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^ \t\r\n]+'))::BIGINT AS n_tokens,
  CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'books' ELSE 'reference' END AS domain
  FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)),
{", ".join(parts)},
goal AS ({above}),
plan AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens, floor(any_value(given) + 1e-6)::BIGINT AS target FROM t JOIN goal USING ({leaf}) GROUP BY {leaf}),
e AS (SELECT t.*, unnest(range({epochs})) AS epoch, tokens, target FROM t JOIN plan USING ({leaf})),
r AS (SELECT *, target - epoch * tokens AS here, sum(n_tokens) OVER (PARTITION BY {leaf}, epoch
  ORDER BY md5(concat_ws(':', '{mixing.SEED}', epoch::VARCHAR, doc_id::VARCHAR)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens FROM r WHERE upto <= here
"""


@query(_mixing_sql())
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("domain", mixing.domain_of(F.col("source")))
    return mixing.mix(docs.select("doc_id", "domain", "lang", "source", "text")).drop("text")


@query()
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_report(table(spark, folder, "documents"))


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(table(spark, folder, "conversations"))


@query()
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.packed_documents(table(spark, folder, "documents"), vocabulary)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(table(spark, folder, "embeddings"))
