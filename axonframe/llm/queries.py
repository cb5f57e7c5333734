"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontaminate import find_contamination
from .fill_in_middle import fim_digest
from .html_diff import extract
from .interleave import shard_digest
from .mixing import mix_digest
from .periodic_runs import runs_digest
from .quality import quality_digest
from .secret_scan import secret_digest
from .simhash_dedup import simhash_components
from .substring_dedup import find_passages
from .suffix_dedup import repeats_digest
from .warc import warc_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_ann": op6_ann,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {}

ORACLES["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level
  FROM r WINDOW w AS (ORDER BY ratio, weight, source IS NULL, source COLLATE "C" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash, d.doc_id, d.size) - d.size / 2.0::DOUBLE AS spot
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN target - whole * source_size > 0 AND spot <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p"""

ORACLES["op5_sharding"] = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i FROM range(256) g(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
table_of AS (SELECT list(v ORDER BY i) AS crc FROM c WHERE k = 8),
d AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS text,
         md5(concat('shard:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS hash
  FROM documents),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY hash, doc_id) - 1
             + CAST(('0x' || substr(md5(concat('shard/', coalesce(source, ''))), 1, 8)) AS BIGINT)::DOUBLE / 4294967296)
            / count(*) OVER (PARTITION BY source) AS spot
  FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY spot, source COLLATE "C" NULLS FIRST, hash, doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
q AS (SELECT *, (place * 16) // n AS shard FROM p)
SELECT doc_id, size,
       CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                            lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
       'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q, table_of"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = " UNION ALL ".join(
    f"""SELECT r, {place} AS place, '{kind}' AS kind, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS gaps,
        list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) AS found,
        list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) AS wide, {least} AS least FROM d"""
    for place, (kind, pattern, group, least) in enumerate([("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)])
)
ORACLES["op1_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_KINDS}),
e AS (SELECT r, place, kind, gaps, found, wide, least, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT r, place, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(found[1:i - 1]), 0) AS BIGINT) AS start, found[i] AS n
      FROM e WHERE wide[i] >= least),
a AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
             string_agg(concat(kind, ':', start, ':', start + n), ',' ORDER BY start, place) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""

ORACLES["op4_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT r, unnest(range(len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d),
bs AS (SELECT item, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM b),
counts AS (SELECT item, shingle, count(*) AS wanted FROM bs GROUP BY ALL),
hits AS (SELECT r, pos, ds.shingle, item, wanted, len(d.w) - 4 AS size, len(b.w) - 4 AS n
         FROM ds JOIN counts USING (shingle) JOIN d USING (r) JOIN b USING (item)),
windows AS (SELECT r, item, size, n, shingle, wanted, unnest(range(greatest(0, pos - n + 1), greatest(0, least(pos, size - n)) + 1)) AS start FROM hits),
common AS (SELECT r, item, start, least(size, n) AS size, n, least(count(*), any_value(wanted)) AS c
           FROM windows GROUP BY r, item, start, size, n, shingle),
scores AS (SELECT r, item, sum(c) / (any_value(size) + any_value(n) - sum(c)) AS similarity FROM common GROUP BY r, item, start)
SELECT doc_id, item_id, CAST(max(similarity) AS DOUBLE) AS similarity
FROM scores JOIN d USING (r) JOIN b USING (item) WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id"""

ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS v FROM d),
c AS (SELECT *, list_min([v[1] % (n + 1), v[2] % (n + 1)]) AS a, list_max([v[1] % (n + 1), v[2] % (n + 1)]) AS b,
      CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR v[3] % 100 >= 100 THEN 'plain' WHEN v[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(list_reduce(list_prepend('', u[:a]), lambda x, y: x || y), '') AS prefix, coalesce(list_reduce(list_prepend('', u[b + 1:]), lambda x, y: x || y), '') AS suffix FROM c),
m AS (SELECT *, substr(text, length(prefix) + 1, length(text) - length(prefix) - length(suffix)) AS middle FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM m"""
