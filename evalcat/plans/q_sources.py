"""Registered source/sink queries: views of the test tables are written in
the reference's file formats (under the shared checkpoint folder) and read
back through the scans, so the oracle is the view itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.plans.adapters import V1_SQL, V2_SQL, V6_PODS_SQL, v1_results, v2_examples, v6_pods
from evalcat.plans.registry import register
from evalcat.session import read_table
from evalcat.sources import files as SRC
from evalcat.streaming.jobs import scratch_path

_RESULT_COLS = ", ".join(SRC.RESULT_COLUMNS)


@register("a5_a6_results_roundtrip", f"WITH v1 AS ({V1_SQL}) SELECT {_RESULT_COLS} FROM v1")
def a5_a6_results_roundtrip(spark, sf_dir):
    """A6 write (fixed columns, JS number text, quoting) then A5 read by
    header name with defaults: must reproduce the table exactly."""
    path = scratch_path(spark, "results_csv")
    SRC.write_results(v1_results(spark, sf_dir).select(*SRC.RESULT_COLUMNS), path)
    return SRC.read_results(spark, path)


@register(
    "a1_b1_jsonl_examples",
    f"WITH v2 AS ({V2_SQL})"
    + """
SELECT example_id, row_number() OVER (ORDER BY example_id) - 1 AS ordinal, 1 AS n_messages,
       prompt AS content, system_prompt, expected_output,
       CASE WHEN isnan(weight) THEN CAST(1 AS DOUBLE) ELSE weight END AS weight
FROM v2
""",
)
def a1_b1_jsonl_examples(spark, sf_dir):
    """A1 + B1: examples written as JSON lines (with blank lines between
    blocks) in id order, scanned back with file-order ordinals."""
    e = v2_examples(spark, sf_dir)
    line = F.to_json(
        F.struct(
            "example_id",
            "prompt",
            "system_prompt",
            "expected_output",
            F.when(~F.isnan("weight"), F.col("weight")).alias("weight"),
        )
    )
    rows = e.select("example_id", line.alias("value")).unionByName(
        e.where(F.col("example_id") % 10 == 0).select((F.col("example_id") - 0.5).cast("double").alias("example_id"), F.lit("   ").alias("value")),
        allowMissingColumns=True,
    )
    path = scratch_path(spark, "examples") + ".jsonl"
    rows.orderBy("example_id").select("value").write.text(path)
    ex = SRC.read_examples(spark, path)
    return ex.select(
        "example_id",
        "ordinal",
        F.size("messages").alias("n_messages"),
        F.get("messages", 0)["content"].alias("content"),
        "system_prompt",
        "expected_output",
        "weight",
    )


@register(
    "a2_a18_csv_examples",
    """
SELECT doc_id AS example_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, text AS content, lang AS expected_output,
       CASE WHEN doc_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(doc_id % 5 AS DOUBLE) END AS weight
FROM documents
""",
)
def a2_a18_csv_examples(spark, sf_dir):
    """A2: CSV examples with quoted multi-line prompt cells and blank
    weights (-> 1.0), scanned back in file order."""
    d = read_table(spark, sf_dir, "documents")
    csv = d.select(
        F.col("doc_id").cast("string").alias("example_id"),
        F.col("text").alias("prompt"),
        F.col("lang").alias("expected_output"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise((F.col("doc_id") % 5).cast("string")).alias("weight"),
        F.col("doc_id").alias("_k"),
    )
    path = scratch_path(spark, "examples_csv")
    csv.orderBy("_k").drop("_k").write.options(**SRC._CSV_WRITE).csv(path)
    ex = SRC.read_examples(spark, path)
    return ex.select(
        "example_id", "ordinal", F.get("messages", 0)["content"].alias("content"), "expected_output", "weight"
    )


@register(
    "a15_ws_table_scan",
    f"WITH pods AS ({V6_PODS_SQL})"
    + """
SELECT parts[1] AS name, parts[2] AS ready_total, parts[3] AS status, len(parts) AS n_fields
FROM (SELECT regexp_split_to_array(trim(line), '\\s+') AS parts FROM pods)
""",
)
def a15_ws_table_scan(spark, sf_dir):
    """Pod listings written as text with a header line and short
    lines, scanned with blank-run splitting; header and short lines skip."""
    pods = v6_pods(spark, sf_dir).select(F.col("line").alias("value"))
    extra = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("inf-d"), F.col("c_custkey").cast("string")).alias("value"))
    header = spark.range(1).select(F.lit("NAME   READY   STATUS   RESTARTS   AGE").alias("value"))
    path = scratch_path(spark, "pods_txt")
    header.unionByName(pods).unionByName(extra).write.text(path)
    t = SRC.read_ws_table(spark, path)
    return t.select(
        F.get("fields", 0).alias("name"),
        F.get("fields", 1).alias("ready_total"),
        F.get("fields", 2).alias("status"),
        F.size("fields").cast("long").alias("n_fields"),
    )


@register(
    "a14_read_inventory",
    "SELECT p_brand AS brand, 'art-' || CAST(p_partkey AS VARCHAR) AS name, p_size AS size FROM part",
)
def a14_read_inventory(spark, sf_dir):
    """``{"items": [...]}`` documents (one per brand file) flattened to
    one row per item."""
    p = read_table(spark, sf_dir, "part")
    docs = p.groupBy("p_brand").agg(
        F.collect_list(
            F.struct(
                F.struct(F.concat(F.lit("art-"), F.col("p_partkey").cast("string")).alias("name")).alias("metadata"),
                F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("spec"),
            )
        ).alias("items")
    )
    path = scratch_path(spark, "inventory")
    docs.repartition("p_brand").write.partitionBy("p_brand").json(path)
    schema = "items array<struct<metadata:struct<name:string>,spec:struct<brand:string,size:int>>>"
    inv = SRC.read_inventory(spark, path, schema=schema)
    return inv.select(F.col("spec.brand").alias("brand"), F.col("metadata.name").alias("name"), F.col("spec.size").alias("size"))


@register(
    "a16_read_artifacts",
    """
SELECT g FROM (SELECT page_id % 16 AS g, bool_or(contains(html, '<title>')) AS m1, bool_or(contains(html, 'lang="de"')) AS m2
               FROM pages GROUP BY page_id % 16) WHERE m1 AND m2
""",
)
def a16_read_artifacts(spark, sf_dir):
    """Whole-text files kept when they contain every marker."""
    p = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 16).alias("g"), F.col("html").alias("value"))
    path = scratch_path(spark, "artifacts")
    p.repartition("g").write.partitionBy("g").text(path)
    arts = SRC.read_artifacts(spark, path, ["<title>", 'lang="de"'])
    return arts.select(F.regexp_extract(F.col("path"), r"/g=(\d+)/", 1).cast("long").alias("g")).distinct()
