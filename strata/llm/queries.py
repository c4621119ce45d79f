"""The registered query of each operator, with production parameters over whole tables, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, exact, exchange as X, langid, lm, mixing, neardup, substring, suffix, toxicity, urls


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(X.documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(X.documents(spark, sf_dir), 20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(X.documents(spark, sf_dir))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup_near(X.documents(spark, sf_dir), width=3, percent=85)


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return lm.score(X.documents(spark, sf_dir), ~held_out)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), X.documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = X.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs.filter(~out), labels.filter(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(X.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(X.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
own AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap
        FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lev AS (SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE AS num,
               (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS den
        FROM own WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pick AS (SELECT num AS lnum, den AS lden FROM lev WHERE num / den <= cap::DOUBLE / w ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
tgt AS (SELECT source, source_size, CASE WHEN num / den > cap::DOUBLE / w OR lnum IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * lnum / lden) END AS target
        FROM lev LEFT JOIN pick ON true),
cum AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
               sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING)::BIGINT AS upto,
               sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS own
        FROM d JOIN tgt ON d.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (passes + CASE WHEN target - passes * source_size > 0 AND 2 * upto - own <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM dup),
wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT wd.doc_id, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY wd.p) FILTER (g.p IS NULL) AS t FROM wd LEFT JOIN gone g ON g.doc_id = wd.doc_id AND g.p = wd.p GROUP BY wd.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, (count(*) OVER p)::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER p AS kept, text_sha256
FROM d WINDOW p AS (PARTITION BY text_sha256)"""


NEARDUP_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(w[p:p+least(len(w), 3)-1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id"""


def _urls_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda t: f"regexp_matches(t, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    strict = " OR ".join(map(has, urls.STRICT))
    soft = [f"{has(t)}::INT" for t in urls.SOFT]
    fits = []
    for rule, verdict in urls.RULES:
        host, slash, path = rule.partition("/")
        fits.append((len(rule), f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN ", rule, verdict))
    fits.sort(key=lambda x: -x[0])
    return f"""
WITH u AS (SELECT page_id, coalesce({low.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, host || {low.format("path")} AS t FROM u)
SELECT page_id, host, path, CASE {" ".join(f"{c}'{r}'" for _, c, r, _ in fits)} ELSE NULL END AS rule,
       CASE {" ".join(f"{c}'{v}'" for _, c, _, v in fits)} WHEN {strict} OR {" + ".join(soft)} >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM j"""


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k == "pipeline" or k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op2_substring": SUBSTRING_SQL, "op3_exact": EXACT_SQL, "op4_urls": _urls_sql(), "op5_neardup": NEARDUP_SQL, "op9_decontam": DECONTAM_SQL}
