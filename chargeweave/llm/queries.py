"""The dealt operators as queries over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chargeweave.llm import (
    ann,
    bpe,
    chat,
    counting,
    minhash,
    mixing,
    pii,
    prefixes,
    quality,
    spelling,
    suffixes,
    warc,
    winnowing,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_rotate_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(_table(spark, sf_dir, "documents"), percent=85)


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.report(_table(spark, sf_dir, "conversations"))


def op13_winnow_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_rotate_speakers,
        op3_weak_pii,
        op4_adaptive_scan,
        op5_minhash_dedup,
        op6_host_quality,
        op7_trie_counts,
        op8_prefix_bpe,
        op9_suffix_dedup,
        op10_warc_revisits,
        op11_spelling_groups,
        op12_prefix_trie,
        op13_winnow_benchmark,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

# The measures of the quality rules; ``documents`` is the table's name.
_MEASURED = r"""
rows_ AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), split_ AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM rows_
), windows_ AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split_ WHERE len(w) > 4)
), repeated_ AS (
  SELECT rid, i FROM windows_ QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered_ AS (
  SELECT rid, sum(least(5, i - before)) AS n
  FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 5) AS before
        FROM repeated_)
  GROUP BY rid
), measured AS (
  SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split_ s LEFT JOIN covered_ c USING (rid)
)"""

_VERDICTS = r"""
hosts AS (
  SELECT source, count(*) AS n,
    count(*) FILTER (n_words < 10) AS short,
    count(*) FILTER (100 * n_repeat_words > 20 * n_words) AS repeat,
    count(*) FILTER (100 * n_symbols > 10 * word_chars) AS symbols,
    count(*) FILTER (n_dup_lines > 30) AS lines
  FROM measured GROUP BY source
), fails AS (
  SELECT source, n, r.rule, r.f FROM (
    SELECT source, n, unnest([{'rule': 'short', 'f': short}, {'rule': 'repeat', 'f': repeat},
                              {'rule': 'symbols', 'f': symbols}, {'rule': 'lines', 'f': lines}]) AS r
    FROM hosts)
), moments AS (
  SELECT rule, sum(n) AS total, sum(f) / sum(n) AS mean,
    sum(f * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2
      - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_
  FROM fails GROUP BY rule
), prior AS (
  SELECT rule, mean, CASE WHEN between_ > 1e-12
    THEN greatest(1.0, least(total, mean * (1 - mean) / between_ - 1)) ELSE total END AS strength
  FROM moments
), verdict AS (
  SELECT source, max((f + mean * strength) / (n + strength)) > 0.5 AS host_failed
  FROM fails JOIN prior USING (rule) GROUP BY source
), judged AS (
  SELECT m.*, host_failed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM measured m JOIN verdict v ON m.source IS NOT DISTINCT FROM v.source
)"""

_ROTATED = r"""
WITH said AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role,
    replace(coalesce(text, ''), '<|im_', '< |im_') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'
), views AS (
  SELECT s.*, p.speaker, '<|im_start|>' || CASE WHEN s.role = p.speaker THEN 'assistant'
      WHEN s.role = 'system' THEN 'system'
      ELSE 'user name=' || replace(url_encode(s.role), '~', '%7E') END || chr(10) AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), sized AS (
  SELECT *, length(head) + length(text) + 11 AS size FROM views
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(size) OVER w - size AS start
  FROM sized
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text, rid)
)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, turn, role,
  head || text || '<|im_end|>' || chr(10) AS rendered,
  CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS "end",
  CAST(CASE WHEN role = speaker THEN start + length(head) ELSE start + size END AS BIGINT) AS mask_start,
  CAST(start + size AS BIGINT) AS mask_end
FROM placed"""

_REVISITS = r"""
WITH bare AS (
  SELECT page_id, md5(coalesce(html, '')) AS payload,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT page_id, payload, 1704067200 + page_id * 60 AS t,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '')
      AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[a-z]*|ref|fbclid|gclid)(?:=|$)'))), '&') AS q
  FROM bare
), keyed AS (
  SELECT page_id, payload, t, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM parts
), revisits AS (
  SELECT k || '-' || page_id AS record_id, url_key, t + shift AS seconds, k,
    CASE k WHEN 'other' THEN 'other' ELSE payload END AS tag
  FROM keyed, (VALUES ('early', -86400), ('same', 3600), ('weak', 86400), ('other', 604800)) AS v(k, shift)
), found AS (
  SELECT r.*, f.page_id AS f_page, f.payload AS f_payload, f.t AS f_t
  FROM revisits r ASOF LEFT JOIN keyed f ON r.url_key = f.url_key AND r.seconds > f.t
), judged AS (
  SELECT *, CASE WHEN f_page IS NULL THEN 'orphan' WHEN tag = f_payload THEN 'resolved' ELSE 'mismatch' END AS status
  FROM found
)
SELECT record_id, url_key, seconds, status, 'full-' || f_page AS refers_to,
  CASE WHEN status = 'resolved' THEN f_payload END AS digest,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
    'cache-control: ' || CASE k WHEN 'weak' THEN 'no-cache' ELSE 'max-age=60' END,
    'content-type: text/html', 'date: ' || seconds,
    'etag: ' || CASE k WHEN 'weak' THEN 'W/' ELSE '' END || '"' || tag || '"',
    CASE k WHEN 'weak' THEN 'vary: Accept' END], lambda x: x IS NOT NULL)), chr(10)) END AS headers
FROM judged"""

_TRIE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), plan AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS opener, xor(4294967295, list_reduce(list_concat([4294967295],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc
), shared AS (
  SELECT p.conv_id, p.opener, p.h, least(p.h, coalesce(o.n, 0)) AS given
  FROM plan p LEFT JOIN plan o ON o.conv_id = p.opener
), rebuilt AS (
  SELECT s.conv_id, nth, role, text FROM shared s JOIN own o ON o.conv_id = s.opener AND nth <= h
  UNION ALL
  SELECT s.conv_id, nth - h + given, role, text FROM shared s JOIN own o ON o.conv_id = s.conv_id AND nth > h
), listed AS (
  SELECT s.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY nth)
      FILTER (nth IS NOT NULL), []) AS m,
    list(strlen(text) ORDER BY nth) FILTER (nth IS NOT NULL) AS b
  FROM shared s LEFT JOIN rebuilt r USING (conv_id) GROUP BY s.conv_id
), steps_ AS (
  SELECT conv_id, depth, array_to_string(m[1:depth], '') AS key,
    CASE WHEN depth > 0 THEN array_to_string(m[1:depth - 1], '') END AS parent,
    CASE WHEN depth > 0 THEN b[depth] ELSE 0 END AS bytes, depth = len(m) AS ends
  FROM (SELECT *, unnest(range(0, len(m) + 1)) AS depth FROM listed)
), nodes AS (
  SELECT depth, key, parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps_ GROUP BY depth, key, parent
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT s.key, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c ON c.key = n.key
  JOIN steps_ s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (key) LEFT JOIN children c ON c.key = n.key LEFT JOIN nodes p ON p.key = n.parent"""

_CONTAMINATED = r"""
WITH sought AS (
  SELECT *, least(len(w), 10) AS span FROM (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark)
  WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS i FROM sought)
), read_ AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_windows AS (
  SELECT rid, span, i, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT rid, span, w, unnest(range(1, len(w) - span + 2)) AS i
        FROM read_, (SELECT DISTINCT span FROM sought))
), met AS (
  SELECT rid, span, i, item FROM doc_windows JOIN item_windows USING (span, g)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + span)) AS p FROM (SELECT DISTINCT rid, span, i FROM met)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  hit.n IS NOT NULL AS contaminated
FROM read_ LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

ORACLES = {
    "op12_prefix_trie": _TRIE,
    "op13_winnow_benchmark": _CONTAMINATED,
    "op2_rotate_speakers": _ROTATED,
    "op10_warc_revisits": _REVISITS,
    "op6_host_quality": f"""WITH {_MEASURED}, {_VERDICTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  host_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged""",
}
