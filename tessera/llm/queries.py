"""The opN_ queries, their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chains, lm, packing, piece, quality, secrets, simhash, suffix, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pruning factor of the search; tests and README have the recall it gives.
ANN_FACTOR = 1.5


def tokenizer_files() -> tuple[str, str, str]:
    """Files and pattern of the byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 100 = 0"), k=10, factor=ANN_FACTOR)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.trained())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer_files())


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_files())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.failed("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~quality.failed("v1")).alias("kept"), "fail_bits", "n_lines")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.clusters(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fp().alias("fingerprint"), "component_id")


def op8_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents")).drop("doc")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_substring_chains": op8_substring_chains,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_url_filters": op10_url_filters,
}

OP6_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
v AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM v),
n AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY r),
t AS (SELECT r, i, w, lead(w, 1) OVER (PARTITION BY r ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS c FROM t WHERE w2 IS NOT NULL),
p AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT r, i FROM g WHERE c > 1 UNION SELECT r, i + 1 FROM g WHERE c > 1 UNION SELECT r, i + 2 FROM g WHERE c > 1) GROUP BY r),
x AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN n USING (r) LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, n_lines FROM b"""

# Windows of 400 bytes as 800 hexadecimal digits, cut from blocks so that long texts are not walked for each.
OP3_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n_bytes FROM d),
b AS (SELECT r, x AS base, substring(h, CAST(2 * x + 1 AS BIGINT), 2 * 2447) AS part, least(2048, n_bytes - 399 - x) AS many FROM (SELECT r, h, n_bytes, unnest(range(0, n_bytes - 399, 2048)) AS x FROM n WHERE n_bytes >= 400)),
w AS (SELECT r, base + i AS i, md5_number(substring(part, CAST(2 * i + 1 AS BIGINT), 800)) AS k FROM (SELECT r, base, part, unnest(range(0, many)) AS i FROM b)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w WHERE k IN (SELECT k FROM again)),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
cut AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run),
kept AS (SELECT r, string_agg(substring(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substring(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS k, sum(e - a) AS n_removed, count(*) AS n_spans FROM cut JOIN n USING (r) GROUP BY r)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM n LEFT JOIN kept USING (r)"""

_NODE = "lower(regexp_extract({u}, '(?s)^(.*?://)', 1)) || translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_RULE = """CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""

OP10_SQL = rf"""WITH RECURSIVE tags AS (SELECT url AS src, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS dst FROM pages WHERE url IS NOT NULL),
links AS (SELECT src, dst FROM (SELECT src, CASE WHEN dst LIKE '%://%' THEN dst WHEN starts_with(dst, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || dst WHEN starts_with(dst, '/') THEN regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) || dst END AS dst FROM tags WHERE src LIKE '%://%') WHERE dst LIKE '%://%'),
urls AS (SELECT page_id, url FROM pages UNION ALL SELECT NULL, src FROM links UNION ALL SELECT NULL, dst FROM links),
parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM urls),
nodes AS (SELECT *, CASE WHEN url LIKE '%://%' THEN {_NODE.format(u="url")} END AS node, {_RULE} AS rule FROM parts),
edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM links JOIN nodes a ON a.url = src JOIN nodes b ON b.url = dst WHERE a.node <> b.node),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
told AS (SELECT node, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed, bool_or(rule IN ('net/', 'example.com/de/')) AS blocked FROM nodes WHERE rule IS NOT NULL AND node IS NOT NULL GROUP BY node),
spread AS (SELECT node, allowed, blocked FROM told UNION ALL SELECT y, allowed, blocked FROM told JOIN reach ON node = x),
class AS (SELECT node, bool_or(allowed) AS allowed, bool_or(blocked) AS blocked FROM spread GROUP BY node)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END AS verdict FROM nodes LEFT JOIN class USING (node) WHERE page_id IS NOT NULL"""

#: The other operators are beyond SQL (trees, tokenizers, hashes that DuckDB lacks, models); tests hold them against
#: brute force.
ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL, "op10_url_filters": OP10_SQL}
