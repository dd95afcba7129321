"""The registered queries ``opN_<name>``: each applies its operator to a whole
table with production parameters and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs):
    """The contract of op1 over any documents. Of the ids only the digest is
    kept: ``packing.pack_documents`` is the form that keeps them."""
    from evalcat.llm import packing
    from evalcat.llm.common import staged, with_rid

    pieces = packing.tokenize(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    digests = staged(with_rid(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "item_id"), "pieces")
    return digests.join(packing.pack_items(digests.select("item_id", "length")), "item_id").drop("item_id")


@query
def op1_pack_documents(spark, sf_dir):
    return packed(read_table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark, sf_dir):
    from evalcat.llm import token_files

    manifest, ranks = token_files.write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, manifest, ranks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc_archives(spark, sf_dir):
    from evalcat.llm import warc

    manifest = warc.write_archives(read_table(spark, sf_dir, "pages"), min_bytes=0)
    records = warc.read_archives(spark, manifest, with_data=False).where("is_last")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc_archives"] = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY n, hex) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query
def op2_near_vectors(spark, sf_dir):
    from evalcat.llm import vector_join

    return vector_join.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
ORACLES["op2_near_vectors"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding) WHERE {_COS} >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""


@query
def op6_rule_quality(spark, sf_dir):
    from evalcat.llm import quality

    scored = quality.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    out = quality.held_out(F.col("doc_id"), 5, 0)
    return scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_string_kernel_toxicity(spark, sf_dir):
    from evalcat.llm import quality, toxicity

    scored = toxicity.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    out = quality.held_out(F.col("doc_id"), 3, 1)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_near_duplicates(spark, sf_dir):
    from evalcat.llm import near_dup

    _, classes = near_dup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)
    return classes.select("doc_id", "class_id", "kept")


@query
def op8_benchmark_leaks(spark, sf_dir):
    from evalcat.llm import decontaminate

    marked = decontaminate.with_leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), threshold=0.8)
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op4_license_scan(spark, sf_dir):
    from evalcat.llm import license_scan

    return license_scan.scan(read_table(spark, sf_dir, "documents"), least=0.8)


@query
def op5_backoff_scores(spark, sf_dir):
    from evalcat.llm import lm_score

    scores = lm_score.lm_scores(read_table(spark, sf_dir, "documents"), order=2, alpha=0.4)
    return scores.select("doc_id", "words", F.round("log_score", 4).alias("log_score"))


ORACLES["op5_backoff_scores"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT x.r, x.i, x.w, y.w AS v FROM w x LEFT JOIN w y ON y.r = x.r AND y.i = x.i - 1),
n AS (SELECT count(*) AS n FROM w),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w), o1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w), o2 AS (SELECT r, v, w, count(*) AS c FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
l AS (SELECT r, count(*) AS words FROM w GROUP BY r),
s AS (SELECT b.r, CASE
    WHEN c2.c - o2.c > 0 THEN ln((c2.c - o2.c) / (cv.c - ov.c))
    ELSE CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN cw.c - ow.c > 0 THEN ln((cw.c - ow.c) / (n.n - l.words)) ELSE ln(1 / (n.n - l.words + 1)) END
  END AS x
  FROM b CROSS JOIN n JOIN l USING (r) JOIN c1 cw ON cw.w = b.w JOIN o1 ow ON ow.r = b.r AND ow.w = b.w
  LEFT JOIN c1 cv ON cv.w = b.v LEFT JOIN o1 ov ON ov.r = b.r AND ov.w = b.v
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN o2 ON o2.r = b.r AND o2.v = b.v AND o2.w = b.w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS words, round(x, 4) AS log_score
FROM d LEFT JOIN (SELECT r, sum(x) AS x FROM s GROUP BY r) USING (r)
"""


@query
def op13_filter_audit(spark, sf_dir):
    from evalcat.llm import filter_audit

    return filter_audit.audit(filter_audit.document_cells(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


ORACLES["op13_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
  'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS x
  FROM w LEFT JOIN marks USING (doc_id)),
g AS (SELECT part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INT), 1) AS own, substr(filter_order, 1, CAST(step AS INT) - 1) AS earlier FROM o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, own, n, good, toxic, fails, len(translate(fails, earlier, '')) = len(fails) AS alive, contains(fails, own) AS hit FROM g, s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (alive AND NOT hit) AS kept, sum(n) FILTER (alive AND hit) AS removed, sum(n) FILTER (hit AND NOT alive) AS redundant,
  sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (alive AND hit) AS good_lost, sum(toxic) FILTER (alive AND hit) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""


@query
def op12_progressive_clusters(spark, sf_dir):
    from evalcat.llm import progressive

    return progressive.cluster(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")[0]


def _rounds_sql(k: int, rounds: int) -> str:
    """Rounds of assignment (a) and of new centroids (c), one after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT p.r, c{i}.c, sum((p.x - c{i}.x) * (p.x - c{i}.x)) AS d FROM p JOIN c{i} USING (j) GROUP BY ALL) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, j, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN
  (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM p JOIN a{i} USING (r) GROUP BY c, j) m USING (c, j))""")
    return ",\n".join(steps)


ORACLES["op12_progressive_clusters"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 16384)) = 0),
p AS MATERIALIZED (SELECT r, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM v),
c0 AS MATERIALIZED (SELECT n - 1 AS c, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM (SELECT xs, row_number() OVER (ORDER BY sha256('3:' || vec_id), xs) AS n FROM v WHERE vec_id IS NOT NULL) WHERE n <= 8),
{_rounds_sql(8, 10)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM v JOIN a10 USING (r) JOIN h USING (c)
"""


@query
def op11_graph_neighbours(spark, sf_dir):
    from evalcat.llm import neighbours

    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


#: Exact, as the search is where all vectors share a block.
ORACLES["op11_graph_neighbours"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS n FROM s) WHERE n <= 20
"""
