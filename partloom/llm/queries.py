"""The queries opN_<name>, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import exact_dedup as exact
from partloom.llm import filter_audit, license_scan, mixing, near_dedup, packing, point_in_time, quality_fm, sharding, simhash, substring_dedup, topk_search, url_filter
from partloom.llm.runtime import table

#: Words by bytes 0x20 and 0x09-0x0D, for DuckDB.
SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
WINDOW = 35


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearDedup(shingle=4))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), substring_dedup.SubstringDedup(window=WINDOW))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score_quality(docs, model)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.Packing(tokenizer_path()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_dedup(docs, exact.older_half(docs))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_in_time.point_in_time(*(table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_sharding, op4_near_dedup, op5_substring_dedup, op6_quality, op7_topk_search, op8_mixing, op9_packing, op10_exact_dedup, op11_simhash, op12_point_in_time, op13_filter_audit)}

UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_RULES = ", ".join(f"('{r.rule}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
OP2 = f"""
WITH rules(rule, rhost, rpath, verdict) AS (VALUES {_RULES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {UPPER_TO_LOWER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, length(r.rhost) DESC) AS rn
  FROM parsed p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.rn = 1
"""

OP4 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {SQL_WORDS.format(f"translate(coalesce(text, ''), {UPPER_TO_LOWER})")} AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM worded),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingled s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sizes s JOIN least l ON l.doc_id = s.doc_id
"""

OP5 = f"""
WITH worded AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' '))) AS s
  FROM worded WHERE len(w) >= {WINDOW}),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM repeated),
gone_of AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
cut AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g.g), 0) AS n_removed,
         CASE WHEN g.g IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(g.g, i)) END AS kept
  FROM worded d LEFT JOIN gone_of g ON g.doc_id = d.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""

OP7 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_MIX = mixing.Mixing()
OP8 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({SQL_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM sized GROUP BY source),
weighed AS (SELECT *, list_extract({list(_MIX.weights)}, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_MIX.weights)} + 1 AS INT)) AS w, source_size * {_MIX.epochs} AS cap FROM stats),
ran AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left FROM weighed
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, cap * w_left <= w * left_ AS capped FROM ran),
leveled AS (SELECT *, max(CASE WHEN NOT capped THEN left_ END) OVER () AS left0, max(CASE WHEN NOT capped THEN w_left END) OVER () AS w0 FROM flagged),
targets AS (SELECT source, source_size, source_rows, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(CAST(w * left0 AS BIGINT) AS DOUBLE) / CAST(CAST(w0 AS BIGINT) AS DOUBLE) END AS target FROM leveled),
drawn AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.source_rows, t.target, md5('{_MIX.seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null:' || CAST(d.size AS VARCHAR))) AS draw FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
dealt AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % CAST(ceil(CAST(source_rows AS DOUBLE) / {_MIX.stratum}) AS BIGINT) AS stratum FROM drawn),
summed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, stratum) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY source, stratum ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start_ FROM dealt),
budgeted AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(floor(target * words / source_size + 0.5e0) AS BIGINT) ELSE 0 END AS budget FROM summed)
SELECT doc_id, size, source_size, target,
       passes * size + CASE WHEN passes < {_MIX.epochs} THEN least(greatest(budget - passes * words - start_, 0), size) ELSE 0 END AS taken
FROM budgeted
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP12 = """
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
s AS (
  SELECT row_number() OVER () AS r, sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) + 14400000000 AS known, CAST(coalesce(floor(100e0 * total + 0.5e0), 0) AS BIGINT) AS cents,
         epoch_us(sold_at) + 1000000 * CASE WHEN sale_id IS NULL THEN 0 ELSE (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, d: xor(c >> 8, steps[(xor(c, d) & 255) + 1])), 4294967295) % 259200) END AS t
  FROM sales, crc WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
q AS (SELECT s.*, d, t - d * 86400000000 AS low FROM s, unnest([2, 14]) AS u(d)),
c AS (
  SELECT client_id, click_id, epoch_us(ts) AS e, epoch_us(arrived_at) + 14400000000 AS known, CAST(kind IS NOT DISTINCT FROM 'purchase' AS INT) AS bought, CAST(coalesce(floor(100e0 * value + 0.5e0), 0) AS BIGINT) AS cents
  FROM (SELECT DISTINCT * FROM clicks)),
clicked AS (
  SELECT r, d, count(*) AS n_clicks, CAST(sum(c.bought) AS BIGINT) AS n_purchases, CAST(sum(c.cents) AS BIGINT) AS click_cents, arg_max(c.click_id, (c.e, c.click_id)) AS last_click_id
  FROM q JOIN c ON c.client_id = q.client_id AND c.e > q.low AND c.e <= q.t AND c.known <= q.t GROUP BY r, d),
usable AS (SELECT q.r, q.d, q.t, p.sale_id, p.cents FROM q JOIN s p ON p.client_id = q.client_id AND p.sold > q.low AND p.sold <= q.t AND p.known <= q.t),
sold AS (SELECT r, d, count(*) AS n_sales, CAST(sum(cents) AS BIGINT) AS sale_cents FROM usable GROUP BY r, d),
sent AS (
  SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, CAST(sum(coalesce(floor(100e0 * amount + 0.5e0), 0)) AS BIGINT) AS line_cents
  FROM usable u JOIN sale_lines l ON l.sale_id = u.sale_id AND epoch_us(l.shipped_at) <= u.t GROUP BY r, d),
ahead AS (SELECT DISTINCT a.r FROM s a JOIN s b ON b.client_id = a.client_id AND b.sold > a.t AND b.sold <= a.t + 604800000000)
SELECT q.sale_id, CAST(q.d AS INT) AS d, q.t AS t_us, a.r IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents, last_click_id,
       coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
FROM q LEFT JOIN clicked x ON x.r = q.r AND x.d = q.d LEFT JOIN sold y ON y.r = q.r AND y.d = q.d LEFT JOIN sent z ON z.r = q.r AND z.d = q.d LEFT JOIN ahead a ON a.r = q.r
"""

OP13 = f"""
WITH RECURSIVE seen AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, {SQL_WORDS.format("coalesce(text, '')")} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
told AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(s.doc_id > first_id, false) AS INT) AS m
  FROM seen s LEFT JOIN told l ON l.doc_id = s.doc_id),
cells AS (SELECT part, m, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM failing GROUP BY part, m),
orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE strpos(filter_order, x) = 0),
steps AS (
  SELECT filter_order, CAST(k AS INT) AS step, 1 << CAST(ascii(substr(filter_order, k, 1)) - 65 AS INT) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << CAST(ascii(substr(filter_order, i, 1)) - 65 AS INT))), 0) AS INT) AS gone
  FROM orders, unnest([1, 2, 3, 4, 5]) AS u(k) WHERE length(filter_order) = 5)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN m & (bit | gone) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN m & bit <> 0 AND m & gone = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN m & bit <> 0 AND m & gone <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN m = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN m & bit <> 0 AND m & gone = 0 THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN m & bit <> 0 AND m & gone = 0 THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN m & bit <> 0 THEN n * 120 // bit_count(m) ELSE 0 END) AS BIGINT) AS shapley
FROM cells, steps GROUP BY part, filter_order, step
"""

#: SQL can't express template retrieval (1), the search for the smallest capacity (3), a fitted model (6) or a tokenizer (9).
SQL = {"op2_url_filter": OP2, "op4_near_dedup": OP4, "op5_substring_dedup": OP5, "op7_topk_search": OP7, "op8_mixing": OP8, "op10_exact_dedup": OP10, "op12_point_in_time": OP12, "op13_filter_audit": OP13}
