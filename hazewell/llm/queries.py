"""One query for each operator of this subpackage, over its whole table, beside the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazewell.llm import backoff_model, html_text, near_dups, qgram_leaks, resampling, robust_rules, secret_owners, shard_table, source_mix, token_files, url_filter, warc, whitening
from hazewell.llm.common import table
from hazewell.session import shared_dir, stored


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged AS (
  SELECT page_id, host, path, rule_host, rule_path, rule_verdict, length(rule_host) * 1000 + length(rule_path) AS depth
  FROM parts LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, max_by(rule_host || rule_path, depth) AS rule, coalesce(max_by(rule_verdict, depth), 'allow') AS verdict
FROM judged GROUP BY page_id, host, path
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = robust_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op4_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_leaks.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_backoff_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff_model.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, taken = source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, f"warc-{uuid.uuid4().hex}")
    stored(warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder), "warc-files")
    records = warc.read(spark, folder)
    # responses give bytes and digest of the payload that was read; revisits have what their headers say of it
    size = F.coalesce(F.length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return records.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM bodies),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, f"token-files-{uuid.uuid4().hex}")
    files = token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_starts(spark, stored(files, "token-files")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op11_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the repositories, sources the owners."""
    found = secret_owners.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.sha2(secret_owners.written(secret_owners.base_findings(F.col("findings"))), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secret_owners.written(F.col("findings")).alias("spans"))


def _op11_found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return (f"SELECT r, doc_id, source, '{kind}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(text, '{p}', 0) AS w, "
            f"regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g FROM docs")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP11_KINDS = [("assign", 1, ASSIGN, 1, 12), ("access", 2, "AKIA[A-Z0-9]+", 0, 18), ("hex", 3, "[0-9a-f]{16,}", 0, 16), ("token", 4, "[A-Za-z0-9_-]{24,}", 0, 24)]
OP11_SQL = "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),\nfound AS (" + "\nUNION ALL ".join(_op11_found(*k) for k in OP11_KINDS) + """),
each AS (SELECT r, doc_id, source, kind, rank, least, unnest(range(1, len(w) + 1)) AS i, w, v, g FROM found WHERE len(w) > 0),
lens AS (SELECT r, doc_id, source, kind, rank, least, i, v[i] AS value, length(g[i]) AS gap, length(w[i]) AS size FROM each),
placed AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM lens),
cand AS (SELECT *, stop - size AS start, stop - length(value) AS begin,
    regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 8
    AND NOT regexp_matches(lower(value), 'example|sample|changeme|placeholder|dummy|your|xxxx|1234567') AS random
  FROM placed WHERE length(value) >= least AND (kind <> 'token' OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9].*[0-9].*[0-9]') AND NOT regexp_matches(value, '([_-].*){4}')))),
live AS (SELECT value FROM cand WHERE random GROUP BY value HAVING count(DISTINCT coalesce('=' || source, '')) <= 2 AND count(DISTINCT coalesce('=' || doc_id, '')) <= 25),
spans AS (
  SELECT DISTINCT r, start, rank, stop, kind FROM cand WHERE kind <> 'token' OR (random AND value IN (SELECT value FROM live))
  UNION SELECT DISTINCT r, begin, 5, stop, 'live' FROM cand WHERE random AND value IN (SELECT value FROM live)),
rows AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank <= 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN rows USING (r)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null where 64 bits can't hold it


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
targets AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
features AS (SELECT r, unnest(words) AS word FROM texts),
bytes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM features UNION SELECT word FROM targets)),
buckets AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h) + 1, 2), lambda i: CAST('0x' || substring(h, i, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, steps),
s AS (SELECT bucket, count(*) AS s FROM features JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM targets JOIN buckets USING (word) GROUP BY 1),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE)) / ((s + 1) * CAST(coalesce((SELECT sum(t) FROM t), 0) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
sums AS (SELECT r, sum(gain) AS total, count(*) AS n FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n), 0) AS BIGINT) AS weight,
  (CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM texts LEFT JOIN sums USING (r)),
final AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_url_filter, op2_html_text, op3_robust_rules, op4_qgram_leaks, op5_backoff_model, op6_source_mix, op7_warc, op8_token_files, op9_near_dups, op10_shard_table,
                            op11_secret_owners, op12_whitening, op13_resampling)
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op7_warc": OP7_SQL, "op11_secret_owners": OP11_SQL, "op13_resampling": OP13_SQL}
