"""Adapter views: deterministic evaluation/catalog tables derived from the
shared test tables. Each view exists twice, as a DataFrame builder and as the
equivalent DuckDB SQL text, so that a registered query and its oracle start
from identical rows. Modulo arithmetic here only *derives attribute values*;
no view drops rows.

V1 results      <- events
V2 examples     <- documents (+ benchmark)
V3 calls        <- lineitem
V4 turns        <- conversations
V5 catalog      <- part, supplier
V6 deployments  <- customer, orders
V7 runs         <- orders
V8 vectors      <- embeddings
V9 run log      <- orders, lineitem
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcat.session import read_table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --------------------------------------------------------------------------- #
# V1 results (one evaluation result row per event)
# --------------------------------------------------------------------------- #
def v1_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    is_err = F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("result_id"),
        F.when(is_err, "error").otherwise("completed").alias("status"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"),
        F.col("event_id").alias("example_id"),
        F.when(is_err & (k % 2 == 0), F.concat(F.lit("ERROR: "), "props"))
        .when(is_err, F.concat("props", F.lit("\n\n[JUDGE ERROR: timeout]")))
        .otherwise(F.concat("event_type", F.lit(" "), "props"))
        .alias("output"),
        F.when(is_err, F.lit(0.0)).otherwise((k % 6).cast("double") / 5).alias("score"),
        F.when(F.col("event_id") % 11 == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("weight"),
        F.when(k % 4 == 0, F.concat(F.lit("judge note "), k.cast("string"))).alias("score_reason"),
        (F.col("user_id") * 10 + k).alias("input_tokens"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("long")).otherwise(k).alias("output_tokens"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value") * 0.25)
        .alias("ttft_ms"),
        F.when(k == 0, F.lit(None).cast("double"))
        .otherwise(F.try_divide(k.cast("double") * 1000, F.col("value")))
        .alias("tps"),
        (F.col("event_id") % 3 + 1).alias("num_llm_calls"),
        F.col("ts").cast("timestamp").alias("finished_at"),
        F.col("user_id"),
        F.concat(F.lit("exp"), (F.col("user_id") % 2).cast("string")).alias("experiment_id"),
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
    )


V1_SQL = """
SELECT event_id + 1 AS result_id,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'completed' END AS status,
       'p' || CAST(user_id % 3 AS VARCHAR) AS provider,
       'm' || CAST(user_id % 5 AS VARCHAR) AS model,
       event_id AS example_id,
       CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'ERROR: ' || props
            WHEN event_type = 'error' THEN props || chr(10) || chr(10) || '[JUDGE ERROR: timeout]'
            ELSE event_type || ' ' || props END AS output,
       CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE)
            ELSE CAST(k % 6 AS DOUBLE) / 5 END AS score,
       CASE WHEN event_id % 11 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight,
       CASE WHEN k % 4 = 0 THEN 'judge note ' || CAST(k AS VARCHAR) END AS score_reason,
       user_id * 10 + k AS input_tokens,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE k END AS output_tokens,
       value AS latency_ms,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * CAST(0.25 AS DOUBLE) END AS ttft_ms,
       CASE WHEN k = 0 OR value = 0 THEN NULL ELSE CAST(k AS DOUBLE) * 1000 / value END AS tps,
       event_id % 3 + 1 AS num_llm_calls,
       ts AS finished_at,
       user_id,
       'exp' || CAST(user_id % 2 AS VARCHAR) AS experiment_id,
       'run' || CAST(user_id % 4 AS VARCHAR) AS run_id
FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)
"""


# --------------------------------------------------------------------------- #
# V2 examples (one evaluation example per document, plus a model output)
# --------------------------------------------------------------------------- #
def v2_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    first_word = F.split(F.col("text"), " ").getItem(0)
    kind = F.col("doc_id") % 4
    return d.select(
        F.col("doc_id").alias("example_id"),
        F.col("text").alias("prompt"),
        F.when(F.col("lang") == "en", F.lit(None).cast("string"))
        .when(F.col("lang") == "fr", F.lit(""))
        .otherwise(F.concat(F.lit("Answer in "), "lang"))
        .alias("system_prompt"),
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("Contains: "), first_word))
        .when(kind == 2, F.lit("ratio:"))
        .otherwise(F.lit(""))
        .alias("expected_output"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan")))
        .otherwise((F.col("doc_id") % 3 + 1).cast("double"))
        .alias("weight"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), "text", F.lit("\n")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Answer: "), "text"))
        .when(
            F.col("doc_id") % 5 == 2,
            F.concat(
                (F.col("doc_id") % 7).cast("string"),
                F.lit(" / "),
                (F.col("doc_id") % 4).cast("string"),
                F.lit(" sub-steps passed"),
            ),
        )
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("In "), first_word, F.lit(" end")))
        .otherwise(F.lit(""))
        .alias("output"),
        "lang",
        "source",
    )


V2_SQL = """
SELECT doc_id AS example_id,
       text AS prompt,
       CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN '' ELSE 'Answer in ' || lang END AS system_prompt,
       CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Contains: ' || split_part(text, ' ', 1)
            WHEN 2 THEN 'ratio:' ELSE '' END AS expected_output,
       CASE WHEN doc_id % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(doc_id % 3 + 1 AS DOUBLE) END AS weight,
       CASE doc_id % 5 WHEN 0 THEN '  ' || text || chr(10)
            WHEN 1 THEN 'Answer: ' || text
            WHEN 2 THEN CAST(doc_id % 7 AS VARCHAR) || ' / ' || CAST(doc_id % 4 AS VARCHAR) || ' sub-steps passed'
            WHEN 3 THEN 'In ' || split_part(text, ' ', 1) || ' end'
            ELSE '' END AS output,
       lang, source
FROM documents
"""


# --------------------------------------------------------------------------- #
# V5 catalog (models, artifacts, inventory, checkpoints) from ``part``
# --------------------------------------------------------------------------- #
def v5_model_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model -> artifact references, one row per part; ``pos`` (list position)
    is the part key, so list order is key order within the model."""
    p = _t(spark, sf_dir, "part")
    brand = F.regexp_replace(F.lower("p_brand"), "brand#", "b")
    ss = F.pow(F.lit(2), F.lit(9) + F.col("p_size") % 8).cast("long")
    bs = F.pow(F.lit(2), F.col("p_size") % 4).cast("long")
    stem = F.concat(brand, F.lit("-"), F.regexp_replace("p_name", " ", ""))
    static = F.concat(
        stem,
        F.lit("-ss"), ss.cast("string"),
        F.lit("-bs"), bs.cast("string"),
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("-sd"), (F.col("p_size") % 10).cast("string"))).otherwise(F.lit("")),
    )
    dyn = F.concat(stem, F.lit("-dyt"))
    return p.select(
        F.concat(F.lit("model-"), brand).alias("model"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_type") == "PROMO", dyn).otherwise(static).alias("artifact"),
        "p_partkey",
        "p_size",
        "p_type",
        "p_retailprice",
    )


V5_MAPPING_SQL = """
SELECT 'model-' || replace(lower(p_brand), 'brand#', 'b') AS model,
       p_partkey AS pos,
       CASE WHEN p_type = 'PROMO'
            THEN replace(lower(p_brand), 'brand#', 'b') || '-' || replace(p_name, ' ', '') || '-dyt'
            ELSE replace(lower(p_brand), 'brand#', 'b') || '-' || replace(p_name, ' ', '')
                 || '-ss' || CAST(CAST(pow(2, 9 + p_size % 8) AS BIGINT) AS VARCHAR)
                 || '-bs' || CAST(CAST(pow(2, p_size % 4) AS BIGINT) AS VARCHAR)
                 || CASE WHEN p_type = 'SMALL' THEN '-sd' || CAST(p_size % 10 AS VARCHAR) ELSE '' END END AS artifact,
       p_partkey, p_size, p_type, p_retailprice
FROM part
"""


def v5_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled-artifact inventory: every referenced artifact except those of
    ECONOMY parts (not compiled on this cluster). Duplicate names resolve to
    the entry of the highest part key (E10 last-entry-wins)."""
    m = v5_model_artifacts(spark, sf_dir).where(F.col("p_type") != "ECONOMY")
    entry = F.struct(
        F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda i: i.cast("string")).alias("version_keys"),
        F.when(F.col("p_size") % 3 == 0, F.lit("embedding")).otherwise(F.lit("text-generation")).alias("task_name"),
        F.when(F.col("p_size") % 6 == 0, F.lit(None).cast("array<long>"))
        .otherwise(F.slice(F.array(*[F.lit(x).cast("long") for x in (1, 2, 4, 8, 16)]), 1, F.col("p_size") % 5 + 1))
        .alias("bs_values"),
        F.when(F.col("p_size") % 6 == 0, F.lit(4).cast("long")).alias("batch_size"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("long")).otherwise(F.lit(8192).cast("long")).alias("seq_min"),
        F.pow(F.lit(2), F.lit(15) + F.col("p_size") % 3).cast("long").alias("seq_max"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("long")).otherwise(F.lit(4096).cast("long")).alias("seq_step"),
    )
    best = m.groupBy("artifact").agg(F.max_by(entry, F.col("p_partkey")).alias("e"))
    return best.select("artifact", "e.*")


V5_INVENTORY_SQL = """
SELECT artifact, e.version_keys, e.task_name, e.bs_values, e.batch_size, e.seq_min, e.seq_max, e.seq_step
FROM (
  SELECT artifact, arg_max({
      'version_keys': list_transform(range(1, p_size % 4 + 2), lambda i: CAST(i AS VARCHAR)),
      'task_name': CASE WHEN p_size % 3 = 0 THEN 'embedding' ELSE 'text-generation' END,
      'bs_values': CASE WHEN p_size % 6 = 0 THEN NULL ELSE [1, 2, 4, 8, 16][1:p_size % 5 + 1] END,
      'batch_size': CASE WHEN p_size % 6 = 0 THEN 4 END,
      'seq_min': CASE WHEN p_size % 4 = 0 THEN NULL ELSE 8192 END,
      'seq_max': CAST(pow(2, 15 + p_size % 3) AS BIGINT),
      'seq_step': CASE WHEN p_size % 4 = 0 THEN NULL ELSE 4096 END}, p_partkey) AS e
  FROM mapping WHERE p_type <> 'ECONOMY' GROUP BY artifact)
"""


def v5_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint entry per model (brand): brand numbers divisible by 7
    have an empty path, by 4 a vision checkpoint, by 5 a preset type."""
    p = _t(spark, sf_dir, "part")
    b = p.select(F.regexp_replace(F.lower("p_brand"), "brand#", "b").alias("brand"), "p_brand").distinct()
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    model = F.concat(F.lit("model-"), "brand")
    return b.select(
        model.alias("model"),
        F.when(n % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit("ckpts/"), model, F.lit("/v"), (n % 3 + 1).cast("string"))
        ).alias("path"),
        F.concat(F.lit("res-"), "brand").alias("resource_name"),
        F.when(n % 4 == 0, F.concat(F.lit("vision/"), model)).alias("vision_embedding_checkpoint"),
        F.when(n % 5 == 0, F.lit("preset")).alias("model_type"),
    )


V5_CHECKPOINTS_SQL = """
SELECT 'model-' || brand AS model,
       CASE WHEN n % 7 = 0 THEN '' ELSE 'ckpts/model-' || brand || '/v' || CAST(n % 3 + 1 AS VARCHAR) END AS path,
       'res-' || brand AS resource_name,
       CASE WHEN n % 4 = 0 THEN 'vision/model-' || brand END AS vision_embedding_checkpoint,
       CASE WHEN n % 5 = 0 THEN 'preset' END AS model_type
FROM (SELECT DISTINCT replace(lower(p_brand), 'brand#', 'b') AS brand,
             CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS n FROM part)
"""

V5_SQL = (
    f"WITH mapping AS ({V5_MAPPING_SQL}),\n"
    f"inventory AS ({V5_INVENTORY_SQL}),\n"
    f"checkpoints AS ({V5_CHECKPOINTS_SQL})\n"
)


# --------------------------------------------------------------------------- #
# V3 calls (one LLM call per lineitem)
# --------------------------------------------------------------------------- #
def v3_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("result_id"),
        F.col("l_linenumber").alias("call_no"),
        (F.col("l_partkey") % 1000).alias("input_tokens"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("long"))
        .otherwise(F.col("l_quantity").cast("long"))
        .alias("output_tokens"),
        F.col("l_extendedprice").alias("latency_ms"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice") * F.col("l_tax"))
        .alias("ttft_ms"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_discount") * 1000)
        .alias("tps"),
        "l_returnflag",
        "l_partkey",
        "l_tax",
        "l_discount",
    )


V3_SQL = """
SELECT l_orderkey AS result_id, l_linenumber AS call_no, l_partkey % 1000 AS input_tokens,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS output_tokens,
       l_extendedprice AS latency_ms,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * l_tax END AS ttft_ms,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 1000 END AS tps,
       l_returnflag, l_partkey, l_tax, l_discount
FROM lineitem
"""


# --------------------------------------------------------------------------- #
# V6 deployments, bundles and pods (customer, orders)
# --------------------------------------------------------------------------- #
def v6_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    name = F.concat(F.lit("b-"), F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"))
    cond = F.struct(
        F.lit("Validated").alias("type"),
        F.when(F.col("c_acctbal") > 5000, F.lit("True")).otherwise(F.lit("False")).alias("status"),
        F.when(F.col("c_acctbal") > 5000, F.lit("ValidationSucceeded")).otherwise(F.lit("ValidationFailed")).alias("reason"),
        F.when(F.col("c_acctbal") > 5000, F.lit("")).otherwise(
            F.concat(F.lit("model missing: "), F.col("c_name"), F.lit("\n  check artifacts \n\nretry"))
        ).alias("message"),
    )
    return c.select(
        name.alias("name"),
        F.concat(F.lit("ns"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.concat(F.lit("bt-"), F.lower("c_mktsegment")).alias("template"),
        F.when(F.col("c_acctbal") < 1000, F.array().cast(
            "array<struct<type:string,status:string,reason:string,message:string>>"
        )).otherwise(F.array(cond)).alias("conditions"),
        F.array(
            F.concat(F.lit("model-b"), (F.col("c_custkey") % 25 + 1).cast("string")),
            F.concat(F.lit("Model-B"), (F.col("c_nationkey") + 1).cast("string")),
        ).alias("models"),
        "c_custkey",
        "c_acctbal",
    )


V6_BUNDLES_SQL = """
SELECT 'b-' || lower(c_mktsegment) || '-' || CAST(c_custkey AS VARCHAR) AS name,
       'ns' || CAST(c_nationkey AS VARCHAR) AS namespace,
       'bt-' || lower(c_mktsegment) AS template,
       CASE WHEN c_acctbal < 1000 THEN []
            ELSE [{'type': 'Validated',
                   'status': CASE WHEN c_acctbal > 5000 THEN 'True' ELSE 'False' END,
                   'reason': CASE WHEN c_acctbal > 5000 THEN 'ValidationSucceeded' ELSE 'ValidationFailed' END,
                   'message': CASE WHEN c_acctbal > 5000 THEN '' ELSE 'model missing: ' || c_name || chr(10) || '  check artifacts ' || chr(10) || chr(10) || 'retry' END}]
       END AS conditions,
       ['model-b' || CAST(c_custkey % 25 + 1 AS VARCHAR), 'Model-B' || CAST(c_nationkey + 1 AS VARCHAR)] AS models,
       c_custkey, c_acctbal
FROM customer
"""


def v6_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pod status line per order, as ``kubectl get pods`` prints it; the
    order date is the poll time."""
    o = _t(spark, sf_dir, "orders")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("cache"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("q-default-n"))
        .otherwise(F.lit("worker"))
    )
    name = F.concat(F.lit("inf-d"), F.col("o_custkey").cast("string"), F.lit("-"), kind, F.lit("-"), F.col("o_orderkey").cast("string"))
    total = F.col("o_orderkey") % 3 + 1
    ready = F.when(F.col("o_orderstatus") == "F", total).when(F.col("o_orderstatus") == "O", total - 1).otherwise(F.lit(0))
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("Running"))
        .when(F.col("o_orderstatus") == "O", F.lit("ContainerCreating"))
        .otherwise(F.lit("Pending"))
    )
    line = F.concat_ws(
        "   ",
        name,
        F.concat(ready.cast("string"), F.lit("/"), total.cast("string")),
        status,
        (F.col("o_orderkey") % 5).cast("string"),
        F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit("m")),
    )
    return o.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("deployment"),
        F.col("o_orderdate").cast("timestamp").alias("polled_at"),
        F.col("o_orderkey").alias("seq"),
        line.alias("line"),
    )


V6_PODS_SQL = """
SELECT 'd' || CAST(o_custkey AS VARCHAR) AS deployment, o_orderdate AS polled_at, o_orderkey AS seq,
       'inf-d' || CAST(o_custkey AS VARCHAR) || '-'
         || CASE o_orderpriority WHEN '1-URGENT' THEN 'cache' WHEN '2-HIGH' THEN 'q-default-n' ELSE 'worker' END
         || '-' || CAST(o_orderkey AS VARCHAR)
         || '   ' || CAST(CASE o_orderstatus WHEN 'F' THEN o_orderkey % 3 + 1 WHEN 'O' THEN o_orderkey % 3 ELSE 0 END AS VARCHAR)
         || '/' || CAST(o_orderkey % 3 + 1 AS VARCHAR)
         || '   ' || CASE o_orderstatus WHEN 'F' THEN 'Running' WHEN 'O' THEN 'ContainerCreating' ELSE 'Pending' END
         || '   ' || CAST(o_orderkey % 5 AS VARCHAR) || '   ' || CAST(o_orderkey % 90 AS VARCHAR) || 'm' AS line
FROM orders
"""


# --------------------------------------------------------------------------- #
# V7 runs (one evaluation run per order)
# --------------------------------------------------------------------------- #
def v7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    started = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
        .when(F.col("o_orderstatus") == "O", F.lit("running"))
        .when(F.col("o_orderkey") % 2 == 0, F.lit("aborted"))
        .otherwise(F.lit("interrupted"))
    )
    finished = F.when(
        F.col("o_orderstatus") != "O",
        F.timestamp_seconds(F.unix_timestamp(started) + (F.col("o_totalprice") / 10).cast("long")),
    )
    return o.select(
        F.concat(F.lit("exp"), F.col("o_custkey").cast("string")).alias("experiment_id"),
        F.date_format(started, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'").alias("run_id"),
        status.alias("status"),
        started.alias("started_at"),
        finished.alias("finished_at"),
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
    )


V7_SQL = """
SELECT 'exp' || CAST(o_custkey AS VARCHAR) AS experiment_id,
       strftime(started_at, '%Y-%m-%dT%H-%M-%S-') || lpad(CAST(CAST(epoch_ms(started_at) % 1000 AS BIGINT) AS VARCHAR), 3, '0') || 'Z' AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'aborted' ELSE 'interrupted' END END AS status,
       started_at,
       CASE WHEN o_orderstatus <> 'O' THEN started_at + to_seconds(CAST(trunc(o_totalprice / 10) AS BIGINT)) END AS finished_at,
       o_orderkey, o_custkey, o_totalprice
FROM (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS started_at FROM orders)
"""


# --------------------------------------------------------------------------- #
# V8 vectors (embeddings)
# --------------------------------------------------------------------------- #
def v8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        "vec_id",
        "label",
        vec.alias("a"),
        # a perturbed copy: every label-th element shifted by a tolerance-sized step
        F.transform(
            vec,
            lambda x, i: F.when(i % (F.col("label") + 2) == 0, x + F.lit(1e-6) * (F.col("label") - 4)).otherwise(x),
        ).alias("b"),
    )


V8_SQL = """
SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
       list_transform(list_zip(embedding, range(0, len(embedding))), lambda p:
         CASE WHEN p[2] % (label + 2) = 0 THEN CAST(p[1] AS DOUBLE) + 1e-6 * (label - 4) ELSE CAST(p[1] AS DOUBLE) END) AS b
FROM embeddings
"""


# --------------------------------------------------------------------------- #
# V4 multi-step problems (one sub-step per conversation turn)
# --------------------------------------------------------------------------- #
def v4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    t = F.col("turn")
    fn = F.concat(F.lit("step_"), t.cast("string"))
    response = (
        F.when(t % 4 == 0, F.concat(F.lit("Here is the code:\n```python\nimport numpy as np\ndef "), fn,
                                     F.lit("(x):\n    return np.sum(x)\n```\n")))
        .when(t % 4 == 1, F.concat(F.lit("Draft:\n```python\n\n```\nFinal:\n```python\nimport os\ndef "), fn,
                                    F.lit("(x):\n    return open(x)\n```")))
        .when(t % 4 == 2, F.concat(F.lit("No fences, just "), F.col("text")))
        .otherwise(F.concat(F.lit("```\nimport json\ndef "), fn, F.lit("(x):\n    return x.__class__.__mro__\n```")))
    )
    verdict = (
        F.when((F.col("conv_id") + t) % 4 == 0, F.lit("PASS"))
        .when((F.col("conv_id") + t) % 4 == 1,
              F.concat(F.lit("FAIL\nTraceback (most recent call last):\n  File \"x\"\nAssertionError: step "), t.cast("string")))
        .when((F.col("conv_id") + t) % 4 == 2, F.lit("TIMEOUT"))
        .otherwise(F.lit("FAIL"))
    )
    return c.select(
        F.col("conv_id").cast("string").alias("problem_id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("import numpy as np"))
        .when(F.col("conv_id") % 3 == 1, F.lit("import numpy as np\nfrom scipy import linalg"))
        .otherwise(F.lit(""))
        .alias("required_dependencies"),
        t.alias("step_idx"),
        F.concat(F.col("conv_id").cast("string"), F.lit("."), (t + 1).cast("string")).alias("step_number"),
        F.col("text").alias("step_description_prompt"),
        F.when(t % 2 == 0, F.concat(F.lit("Background for "), F.col("role"))).otherwise(F.lit("")).alias("step_background"),
        F.concat(F.lit("def "), fn, F.lit("(x):")).alias("function_header"),
        F.lit("    return result").alias("return_line"),
        F.array(F.concat(F.lit("assert "), fn, F.lit("(1) is not None"))).alias("test_cases"),
        F.when((t == 0) & (F.col("conv_id") % 3 == 0), F.lit("def step_0(x):\n    return x")).alias("given_code"),
        response.alias("response"),
        verdict.alias("verdict"),
    )


V4_SQL = """
SELECT CAST(conv_id AS VARCHAR) AS problem_id,
       CASE conv_id % 3 WHEN 0 THEN 'import numpy as np' WHEN 1 THEN 'import numpy as np' || chr(10) || 'from scipy import linalg'
            ELSE '' END AS required_dependencies,
       turn AS step_idx,
       CAST(conv_id AS VARCHAR) || '.' || CAST(turn + 1 AS VARCHAR) AS step_number,
       text AS step_description_prompt,
       CASE WHEN turn % 2 = 0 THEN 'Background for ' || role ELSE '' END AS step_background,
       'def step_' || CAST(turn AS VARCHAR) || '(x):' AS function_header,
       '    return result' AS return_line,
       ['assert step_' || CAST(turn AS VARCHAR) || '(1) is not None'] AS test_cases,
       CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'def step_0(x):' || chr(10) || '    return x' END AS given_code,
       CASE turn % 4
         WHEN 0 THEN 'Here is the code:' || chr(10) || '```python' || chr(10) || 'import numpy as np' || chr(10) || 'def step_'
                     || CAST(turn AS VARCHAR) || '(x):' || chr(10) || '    return np.sum(x)' || chr(10) || '```' || chr(10)
         WHEN 1 THEN 'Draft:' || chr(10) || '```python' || chr(10) || chr(10) || '```' || chr(10) || 'Final:' || chr(10) || '```python'
                     || chr(10) || 'import os' || chr(10) || 'def step_' || CAST(turn AS VARCHAR) || '(x):' || chr(10)
                     || '    return open(x)' || chr(10) || '```'
         WHEN 2 THEN 'No fences, just ' || text
         ELSE '```' || chr(10) || 'import json' || chr(10) || 'def step_' || CAST(turn AS VARCHAR) || '(x):' || chr(10)
              || '    return x.__class__.__mro__' || chr(10) || '```' END AS response,
       CASE (conv_id + turn) % 4 WHEN 0 THEN 'PASS'
            WHEN 1 THEN 'FAIL' || chr(10) || 'Traceback (most recent call last):' || chr(10) || '  File "x"' || chr(10)
                        || 'AssertionError: step ' || CAST(turn AS VARCHAR)
            WHEN 2 THEN 'TIMEOUT' ELSE 'FAIL' END AS verdict
FROM conversations
"""


# --------------------------------------------------------------------------- #
# V9 run log (lifecycle events and finished tasks of runs, as they arrive)
# --------------------------------------------------------------------------- #
def v9_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(experiment_id, run_id, event, ts, seq, total, failed, label), the
    ``part`` in which each arrives and whether it is ``lost``: some of the
    early ones arrive in the last part. Some runs have no create event."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("t"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    none = lambda kind: F.lit(None).cast(kind)

    def event(rows, name, t, seq, total=None, failed=None, label=None):
        return rows.select(
            "o_orderkey", "o_custkey", name.alias("event"), t.alias("t"), seq.cast("long").alias("seq"), (none("long") if total is None else total.cast("long")).alias("total"),
            (none("boolean") if failed is None else failed).alias("failed"), (none("string") if label is None else label).alias("label"),
        )

    label = F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/m #"), F.col("l_partkey").cast("string"))
    pause = F.when((F.col("o_orderkey") + F.col("l")) % 11 == 0, F.lit(20)).otherwise(F.lit(0))
    end = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderkey") % 2 == 0, "abort").otherwise("interrupt")
    ev = (
        event(o.where(F.col("o_orderkey") % 97 != 0), F.lit("create"), F.col("t"), F.lit(0), F.col("o_orderkey") % 50 + 10)
        .unionByName(event(lines, F.lit("row"), F.col("t") + F.col("l") * 7 + pause, F.col("l") * 10_000_000 + F.col("l_partkey"), failed=F.col("l_returnflag") == "R", label=label))
        .unionByName(event(lines.where("l = 3"), F.lit("resume"), F.col("t") + 46, F.col("l_partkey") + 35_000_000, F.floor("l_quantity") + 10))
        .unionByName(event(o.where("o_orderstatus <> 'O'"), end, F.col("t") + 60 + F.col("o_orderkey") % 30, F.lit(100_000_000)))
    )
    ts = F.timestamp_seconds("t")
    lost = ((F.col("o_orderkey") * 31 + F.col("seq")) % 53 == 0) & (ts < F.lit("1994-05-01").cast("timestamp"))
    arrival = F.timestamp_seconds(F.col("t") + (F.col("o_orderkey") * 7 + F.col("seq") * 13) % 20 * 86400)
    part = F.when(lost, 2).when(arrival < F.lit("1994-07-01").cast("timestamp"), 0).when(arrival < F.lit("1996-07-01").cast("timestamp"), 1).otherwise(2)
    return ev.select(
        F.concat(F.lit("exp"), F.col("o_custkey").cast("string")).alias("experiment_id"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run_id"),
        "event", ts.alias("ts"), "seq", "total", "failed", "label", part.alias("part"), lost.alias("lost"),
    )


V9_SQL = """
SELECT 'exp' || CAST(o_custkey AS VARCHAR) AS experiment_id, 'run' || CAST(o_orderkey AS VARCHAR) AS run_id, event, t AS ts, seq, total, failed, label,
       (o_orderkey * 31 + seq) % 53 = 0 AND t < TIMESTAMP '1994-05-01' AS lost
FROM (
  WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders),
  li AS (SELECT * FROM o JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT o_orderkey, o_custkey, 'create' AS event, t, 0 AS seq, o_orderkey % 50 + 10 AS total, NULL AS failed, NULL AS label FROM o WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey, o_custkey, 'row', t + to_seconds(l_linenumber * 7 + CASE WHEN (o_orderkey + l_linenumber) % 11 = 0 THEN 20 ELSE 0 END), l_linenumber * 10000000 + l_partkey, NULL,
         l_returnflag = 'R', 'p' || CAST(l_suppkey % 3 AS VARCHAR) || '/m #' || CAST(l_partkey AS VARCHAR) FROM li
  UNION ALL
  SELECT o_orderkey, o_custkey, 'resume', t + to_seconds(46), 35000000 + l_partkey, CAST(floor(l_quantity) AS BIGINT) + 10, NULL, NULL FROM li WHERE l_linenumber = 3
  UNION ALL
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderkey % 2 = 0 THEN 'abort' ELSE 'interrupt' END,
         t + to_seconds(60 + o_orderkey % 30), 100000000, NULL, NULL, NULL FROM o WHERE o_orderstatus <> 'O')
"""
