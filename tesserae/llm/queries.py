"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann_mih, bm25_packing, bpe_stream, collision_projections, crf_quality, elkan_codes, feistel_output, filter_audit, mixing, odd_sketch, sentence_spans, url_trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_mih.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op3_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(table(spark, sf_dir, "documents"))


def op5_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(table(spark, sf_dir, "pages"))


def op6_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_projections.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_output.materialise(table(spark, sf_dir, "documents")).verified()


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.dedup_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_sentences", "n_removed")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest, payloads=False).drop("payload", "target_uri", "record_id")


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_multi_index_hashing,
    op2_odd_sketch_dedup,
    op3_subset_sum_mix,
    op4_bm25_packing,
    op5_url_trie,
    op6_collision_projections,
    op7_feistel_shards,
    op8_sentence_spans,
    op9_warc_round_trip,
    op10_crf_quality,
    op11_elkan_codes,
    op12_bpe_transducer,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: Fixed rules as rows, each fitted by plain string comparison; the longest host wins, then the longest path.
_OP5 = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT c.page_id, r.host || r.path AS rule, r.verdict, length(r.host) AS lh, length(r.path) AS lp
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)),
best AS (SELECT page_id, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY lh DESC, lp DESC) = 1)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN best b USING (page_id)
"""

#: The sets whole, every pair of texts that shares a shingle, and reachability by a recursive closure.
_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x AS node, x AS seen FROM edges
  UNION SELECT r.node, b.y FROM reach r JOIN edges b ON b.x = r.seen),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sizes s LEFT JOIN least l ON l.node = s.doc_id
"""

#: Records of equal payloads of at least 100 bytes revisit the one with the smallest id.
_OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.h = d.h AND d.n >= 100
"""

#: Every pair of vectors, and reachability by a recursive closure.
_OP6 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.95),
degree AS (SELECT x, count(*) AS c FROM links GROUP BY x),
reach AS (SELECT x AS node, x AS seen FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.seen),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(d.c, 0)::BIGINT AS n_links, coalesce(l.component, e.vec_id) AS component_id, coalesce(l.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""

#: Every order spelled out; each step counts the documents of each mask, and shapley sums what a filter removes over all orders.
_OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 16 ELSE 0 END AS mask
  FROM texts d LEFT JOIN said s ON s.doc_id = d.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, s.step, bits[s.step] AS bit, list_sum(bits[1:s.step])::INT AS upto FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
done AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & (upto - bit) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & (upto - bit) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & (upto - bit) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & (upto - bit) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done
"""


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of plain assignment and means, every distance computed."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT v, part, arg_min(entry, d * 65536 + entry) AS entry, min(d) AS d FROM (
    SELECT p.v, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM part p JOIN b{r} b USING (part)) GROUP BY v, part)"""
    means = """b{s} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b{r}.x) AS x FROM b{r} LEFT JOIN (
    SELECT part, entry, list(m ORDER BY place) AS x FROM (
      SELECT a.part, a.entry, u.place, floor(sum(u.c)::DOUBLE / count(*))::BIGINT AS m
      FROM a{r} a JOIN (SELECT v, part, unnest(x) AS c, unnest(range(len(x))) AS place FROM part) u USING (v, part) GROUP BY ALL)
    GROUP BY part, entry) m USING (part, entry))"""
    steps = [f"{nearest.format(r=r)},\n{means.format(r=r, s=r + 1)}" for r in range(rounds)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT v, p.part, x[p.part * len(x) // {parts} + 1 : (p.part + 1) * len(x) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS part) p),
b0 AS MATERIALIZED (SELECT part, v AS entry, x FROM part WHERE v < {entries}),
{", ".join(steps)},
{nearest.format(r=rounds)},
coded AS (SELECT v, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY v),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (v), books
"""


ORACLES = {"op11_elkan_codes": _op11_sql(), "op13_filter_audit": _OP13, "op6_collision_projections": _OP6, "op9_warc_round_trip": _OP9, "op5_url_trie": _OP5, "op2_odd_sketch_dedup": _OP2}
