"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, exact_dedup, fim, lcp, license_scan, mixing, packing, pii, secrets_scan, simhash,
               suffix_dedup, toxicity, url_filters)
from .common import SPACE, WORD, read


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix, by the order of training."""
    slim = mixing.measured(read(spark, sf_dir, "documents"))
    m = mixing.assign(slim, slim)
    m = m.withColumn("position", F.get("copies", F.lit(0))["position"])
    order = [F.col("position").asc_nulls_last(), F.xxhash64("doc_id")]  # documents not taken spread out at the end
    m = m.repartitionByRange(*order).sortWithinPartitions(*order)
    return m.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{mixing.SEED}:' || COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))) AS h
  FROM documents),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS rk
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS lim FROM s),
o AS (
  SELECT *, lim / weight AS ratio,
         1.5::DOUBLE * SUM(source_size) OVER () AS budget,
         COALESCE(SUM(lim) OVER (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         SUM(weight) OVER (ORDER BY lim / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM w),
l AS (SELECT ARG_MIN((budget - below) / above, ratio) FILTER ((budget - below) / above <= ratio) AS level FROM o),
t AS (SELECT source, source_size, LEAST(lim, (SELECT level FROM l) * weight) AS target FROM w),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS at0
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN (target - at0) * 2 > size THEN size ELSE 0 END
        + CASE WHEN (target - (source_size + at0)) * 2 > size THEN size ELSE 0 END)::BIGINT AS taken
FROM r
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays, for every document."""
    d = exact_dedup.decide(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = f"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256,
         ROW_NUMBER() OVER (ORDER BY doc_id NULLS LAST) AS r FROM documents)
SELECT doc_id, MIN(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, r = MIN(r) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token piece with its sequence and its place there."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    g = simhash.near_groups(read(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, and its significant passages."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    s = toxicity.score_documents(docs, model)
    return s.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans and all spans of every document, as text."""
    s = secrets_scan.scan(read(spark, sf_dir, "documents"))
    order = F.array_sort(F.transform("spans", lambda x: F.struct(
        x["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in secrets_scan.KINDS]), x["kind"]).alias("rank"),
        x["end"].alias("end"), x["kind"].alias("kind"))))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    s = s.withColumn("o", order)

    def n(kind: str):
        return F.size(F.filter("o", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return s.select("doc_id", n("assign"), n("access"), n("hex"), n("novel"),
                    F.sha2(text(F.filter("o", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"),
                    text(F.col("o")).alias("spans"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness."""
    return lcp.compare_edited(read(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that other documents have too."""
    return suffix_dedup.passages(read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that each page's URL was on when it was fetched."""
    captures = url_filters.derived_captures(read(spark, sf_dir, "pages"))
    j = url_filters.judge(captures, url_filters.derived_entries(captures))
    return j.select("page_id", "url", "host", "fetched", "lists", "n_entries", (F.col("n_entries") > 0).alias("blocked"))


def _sql_day(text: str, first: str, days: int) -> str:
    return f"(DATE '{first}' + (('0x' || substr(md5({text}), 1, 6))::BIGINT % {days})::INTEGER)"


_SQL_HOST = r"rtrim(lower(regexp_extract(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"
_SQL_PATH = r"regexp_extract(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SQL_TOPIC = " ".join(f"WHEN regexp_matches(site, '{w}') THEN '{n}'" for n, w in url_filters.TOPICS)
OP3_SQL = f"""
WITH c AS (
  SELECT ROW_NUMBER() OVER () AS capture, page_id, url, {_sql_day("'f' || COALESCE(page_id::VARCHAR, '')", "2024-01-01", 366)} AS fetched,
         {_SQL_HOST} AS host, {_SQL_PATH} AS path FROM pages),
h AS (SELECT DISTINCT regexp_replace(host, '^(?:www|m|blog)[.]', '') AS site FROM c WHERE host <> ''),
named AS (
  SELECT CASE {_SQL_TOPIC} WHEN ('0x' || substr(md5('r' || site), 1, 2))::INT < {url_filters.REVIEWED} THEN 'review' END AS list,
         'domain:' || site AS pattern FROM h
  UNION ALL
  SELECT 'review', pattern FROM (
    SELECT DISTINCT 'path:' || host || '/' || regexp_extract(path, '^/([^/]+)', 1) AS pattern FROM c
    WHERE host <> '' AND regexp_extract(path, '^/([^/]+)', 1) <> '')
  WHERE ('0x' || substr(md5('p' || pattern), 1, 2))::INT < {url_filters.REVIEWED}),
log AS (
  SELECT list, pattern, {_sql_day("'a' || list || '|' || pattern", "2023-10-01", 270)} AS day, 'add' AS action FROM named WHERE list IS NOT NULL
  UNION ALL SELECT list, pattern, {_sql_day("'b' || list || '|' || pattern", "2024-06-30", 120)}, 'remove' FROM named WHERE list IS NOT NULL
  UNION ALL SELECT list, pattern, {_sql_day("'c' || list || '|' || pattern", "2024-11-01", 200)}, 'add' FROM named WHERE list IS NOT NULL),
a AS (
  SELECT c.capture, l.list, l.pattern, l.action,
         ROW_NUMBER() OVER (PARTITION BY c.capture, l.list, l.pattern ORDER BY l.day DESC, l.action DESC) AS latest
  FROM c JOIN log l ON l.day <= c.fetched AND (
    (l.pattern LIKE 'domain:%' AND (c.host = substr(l.pattern, 8) OR ends_with(c.host, '.' || substr(l.pattern, 8))))
    OR (l.pattern LIKE 'path:%' AND starts_with(c.host || c.path || '/', substr(l.pattern, 6) || '/')))),
hit AS (
  SELECT capture, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, COUNT(*) AS n_entries
  FROM a WHERE latest = 1 AND action = 'add' GROUP BY capture)
SELECT page_id, url, host, fetched, COALESCE(lists, '') AS lists, COALESCE(n_entries, 0) AS n_entries,
       COALESCE(n_entries, 0) > 0 AS blocked
FROM c LEFT JOIN hit USING (capture)
"""


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and what was replaced."""
    r = pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return r


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every rewritten document and of its restoration."""
    t = fim.transform(read(spark, sf_dir, "documents"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license texts, for every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def _sql_templates() -> str:
    rows = []
    for i, label, phrase, w in license_scan.templates():
        rows.append(f"({i}, '{label}', {phrase}, {license_scan.gap(len(w))}, string_split('{' '.join(w)}', ' '))")
    return ",\n    ".join(rows)


OP12_SQL = f"""
WITH t(template, label, phrase, gap, w) AS (VALUES
    {_sql_templates()}),
tg AS (SELECT template, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2, unnest(range(len(w))) AS tpos FROM t),
d AS (
  SELECT ROW_NUMBER() OVER () AS uid, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS w
  FROM documents),
g AS (SELECT uid, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2, unnest(range(len(w))) AS pos FROM d),
hit AS (
  SELECT uid, template, pos, tpos, pos - tpos AS diagonal
  FROM g JOIN tg ON g.w0 = tg.w0 AND g.w1 = tg.w1 AND g.w2 = tg.w2),
dia AS (
  SELECT uid, template, diagonal, COUNT(*) AS votes, MIN(pos) AS lo, MAX(pos) AS hi FROM hit GROUP BY uid, template, diagonal),
step AS (
  SELECT dia.*, t.gap, CASE WHEN diagonal - LAG(diagonal) OVER o <= t.gap THEN 0 ELSE 1 END AS new
  FROM dia JOIN t USING (template) WINDOW o AS (PARTITION BY uid, template ORDER BY diagonal)),
isle AS (SELECT *, SUM(new) OVER (PARTITION BY uid, template ORDER BY diagonal) AS island FROM step),
found AS (
  SELECT i.uid, i.template, i.island, COUNT(DISTINCT h.tpos) AS found
  FROM isle i JOIN hit h ON h.uid = i.uid AND h.template = i.template AND h.diagonal = i.diagonal GROUP BY 1, 2, 3),
span AS (
  SELECT uid, template, island, MIN(lo) AS lo, MAX(hi) + {license_scan.K} AS hi, MAX(votes) AS best FROM isle GROUP BY 1, 2, 3),
v AS (
  SELECT s.uid, t.label, (CASE WHEN s.hi - s.lo <= GREATEST(len(t.w) * {license_scan.STRETCH}, len(t.w) + t.gap) THEN f.found
                               ELSE s.best END) / (len(t.w) - {license_scan.K - 1})::DOUBLE AS coverage
  FROM span s JOIN found f ON s.uid = f.uid AND s.template = f.template AND s.island = f.island JOIN t ON t.template = s.template),
base AS (
  SELECT uid, COUNT(*) AS n_base, MIN(diagonal) AS first_word, MAX(diagonal) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM dia JOIN t USING (template) WHERE phrase AND votes = len(w) - {license_scan.K - 1} GROUP BY uid),
named AS (
  SELECT uid, label FROM v WHERE coverage >= {license_scan.MIN_COVERAGE}
  UNION SELECT uid, label FROM dia JOIN t USING (template) WHERE phrase AND votes = len(w) - {license_scan.K - 1}),
labels AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY uid),
top AS (SELECT uid, MAX(coverage) AS score FROM v GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
       COALESCE(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (uid) LEFT JOIN labels USING (uid) LEFT JOIN top USING (uid)
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows, for every conversation after damage."""
    return conversation_repair.repair(conversation_repair.damage(read(spark, sf_dir, "conversations"))).audits()
