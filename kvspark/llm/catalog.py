"""The queries of this subpackage, ``opN_<name>``, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspark.llm.attribution import token_counts
from kvspark.llm.chat import link_quotes
from kvspark.llm.exact import exact_groups
from kvspark.llm.langid import identify
from kvspark.llm.licenses import COPYRIGHT, KNOWN, SPELLINGS, scan
from kvspark.llm.lshforest import near_groups
from kvspark.llm.mixing import mix
from kvspark.llm.packing import pack_documents
from kvspark.llm.quality import BASE_RULES, METHOD_RULES, STOP_WORDS, quality_rules, stop_forms
from kvspark.llm.urls import ALPHABET, SEEN, SIZE, SPAN, STEP, judge



def _tokenizers() -> str:
    """Folder of the public tokenizer files: that of the variable, of the package, or the usual one."""
    if given := os.environ.get("PUBLIC_TOKENIZERS"):
        return given
    try:
        import public_tokenizers
    except ImportError:
        return "/opt/tokenizers"
    return os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


TOKENIZERS = _tokenizers()
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    return identify(table(spark, sf_dir, "documents"))


@register
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    return near_groups(table(spark, sf_dir, "documents"))


@register
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), BASE_RULES, METHOD_RULES)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


_STOPS = ", ".join(f"'{x}'" for x in stop_forms(STOP_WORDS))
_WS = r"[\x20\x09-\x0D]"
SQL["op5_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram,
             unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM p, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(ls) AS n_lines,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '\pL'))) AS n_unlettered,
             len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stop_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '^{_WS}*[-*•]'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_WS}*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN c ON w.r = c.r),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols / n_words <= 0.1
         AND n_unlettered / n_words <= 0.3 AND n_stop_words / n_words >= 0.02
         AND n_dup_lines / n_lines <= 0.4 AND n_bullet_lines / n_lines <= 0.9 AND n_ellipsis_lines / n_lines <= 0.3 AS kept
FROM j
"""


@register
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judge(table(spark, sf_dir, "pages")).drop("score")


@register
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it replies to."""
    return link_quotes(table(spark, sf_dir, "conversations"))


@register
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@register
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "whole", F.array_join("licenses", ",").alias("licenses"), "n_units")


@register
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


SQL["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace(coalesce({column}, ''), '\\r\\n?', chr(10), 'g')"
    out = f"lower(regexp_replace({out}, {_sql_text('(?im)' + COPYRIGHT)}, '', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_sql_text(old)}, {_sql_text(new)})"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"


def _digest(column: str) -> str:
    return f"sha256(trim(regexp_replace({column}, '\\s+', ' ', 'g')))"


SQL["op9_license_scans"] = f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT license, {_digest("t")} AS digest FROM
  (SELECT license, {_canonical("text")} AS t FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}) AS v(license, text)))
  GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical("text")} AS t FROM documents),
u AS (SELECT r, 'whole' AS kind, t AS x FROM d
  UNION ALL SELECT r, 'part', unnest(list_filter(string_split(t, chr(10)), lambda x: x <> '')) FROM d
  UNION ALL SELECT r, 'part', unnest(list_filter(regexp_split_to_array(t, '\\n{{2,}}'), lambda x: contains(trim(x), chr(10)))) FROM d),
f AS (SELECT r, kind, license FROM (SELECT r, kind, {_digest("x")} AS digest FROM u) AS x JOIN k ON k.digest = x.digest)
SELECT d.doc_id, max(CASE WHEN kind = 'whole' THEN license END) AS whole,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, count(CASE WHEN kind = 'part' THEN 1 END) AS n_units
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL["op6_url_filters"] = rf"""
WITH s AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_CAPITALS}', '{_CAPITALS.lower()}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
u AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  list_transform(string_split('^^' || regexp_replace(regexp_replace(lower(url), '[0-9]', '0', 'g'), '[^a-z0./\-_?=&#%:]', '*', 'g') || '$', ''),
    lambda c: instr('{ALPHABET}', c) - 1) AS codes FROM s),
g AS (SELECT r, page_id, host, path, rule, rule IN ('example.net/en/', 'org/fr/') AS allow,
  list_transform(generate_series(3, len(codes)), lambda i: (codes[i - 2] * {SIZE} + codes[i - 1]) * {SIZE} + codes[i]) AS grams FROM u),
n AS (SELECT allow, gram, count(*) AS n FROM (SELECT allow, unnest(grams) AS gram FROM g WHERE rule IS NOT NULL) GROUP BY allow, gram),
full0 AS (SELECT x.allow, x.gram, x.gram // {SIZE * SIZE} AS a, x.gram // {SIZE} % {SIZE} AS b, x.gram % {SIZE} AS c, coalesce(n.n, 0) AS n3
  FROM (SELECT unnest(generate_series(0, {SIZE**3 - 1})) AS gram, allow FROM (VALUES (true), (false)) AS v(allow)) AS x
  LEFT JOIN n ON n.gram = x.gram AND n.allow = x.allow),
full1 AS (SELECT *, sum(n3) OVER (PARTITION BY allow, b, c) AS n2, sum(n3) OVER (PARTITION BY allow, c) AS n1 FROM full0),
full2 AS (SELECT *, sum(n3) OVER (PARTITION BY allow, a, b) AS ctx2, sum(CAST(n3 > 0 AS INT)) OVER (PARTITION BY allow, a, b) AS kinds2,
  sum(CASE WHEN a = 0 THEN n2 ELSE 0 END) OVER (PARTITION BY allow, b) AS ctx1,
  sum(CASE WHEN a = 0 AND n2 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY allow, b) AS kinds1,
  sum(CASE WHEN a = 0 AND b = 0 THEN n1 ELSE 0 END) OVER (PARTITION BY allow) AS total FROM full1),
p0 AS (SELECT *, CAST(n1 + 1 AS DOUBLE) / (total + {SIZE}) AS q0 FROM full2),
p1 AS (SELECT *, CASE WHEN ctx1 < {SEEN} THEN q0 ELSE (n2 + kinds1 * q0) / (ctx1 + kinds1) END AS q1 FROM p0),
p2 AS (SELECT *, CASE WHEN ctx2 < {SEEN} THEN q1 ELSE (n3 + kinds2 * q1) / (ctx2 + kinds2) END AS q2 FROM p1),
m AS (SELECT list(d ORDER BY gram) AS d FROM (SELECT gram, sum(CASE WHEN allow THEN ln(q2) ELSE -ln(q2) END) AS d FROM p2 GROUP BY gram)),
sc AS (SELECT g.*, list_sum(list_transform(grams, lambda x: m.d[x + 1])) / greatest(len(grams), 1) AS score FROM g, m),
h AS (SELECT least(greatest(floor((score + {SPAN}) / {STEP}), 0), {int(2 * SPAN / STEP)}) AS bin,
  sum(CAST(allow AS INT)) AS good, sum(CAST(NOT allow AS INT)) AS bad FROM sc WHERE rule IS NOT NULL GROUP BY 1),
l AS (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin) + 1, bin) AS before,
  coalesce(sum(good) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(good) OVER ()
  - coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(bad) OVER () AS loss FROM h),
t AS (SELECT (bin + before) / 2 * {STEP} - {SPAN} AS cut FROM l ORDER BY loss, bin LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN score >= cut THEN 'allow' ELSE 'block' END AS verdict FROM sc, t
"""
