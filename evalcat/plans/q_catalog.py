"""Registered queries over V5 (model catalog derived from ``part``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcat.functions import catalog as K
from evalcat.operators import catalog as C
from evalcat.plans.adapters import V5_SQL, v5_checkpoints, v5_inventory, v5_model_artifacts
from evalcat.plans.registry import register
from evalcat.session import read_table


# ---------------------------------------------------------------- SQL helpers
def num_text_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def size_text_sql(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} < 1024 THEN {num_text_sql(d)} ELSE {num_text_sql(f'({d} / 1024)')} || 'k' END"


def size_num_sql(x: str) -> str:
    return (
        f"CASE WHEN ends_with({x}, 'k') THEN TRY_CAST(left({x}, length({x}) - 1) AS DOUBLE) * 1024 "
        f"ELSE TRY_CAST({x} AS DOUBLE) END"
    )


def parse_int_sql(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '^\\s*([+-]?\\d+)', 1) AS BIGINT)"


_CONFIGS_SQL = f"""
, inv2 AS (
  SELECT *, contains(artifact, 'dyt') AS dyn,
         bs_values IS NOT NULL AND len(bs_values) > 0 AND seq_max IS NOT NULL AS has_values,
         batch_size IS NOT NULL AND seq_max IS NOT NULL AS static_batch,
         regexp_extract(artifact, 'ss(\\d+)', 1) AS p_ss, regexp_extract(artifact, 'bs(\\d+)', 1) AS p_bs,
         CASE WHEN seq_min IS NOT NULL AND seq_step IS NOT NULL
              THEN list_filter(list_transform(range(0, 63), lambda i: seq_max >> i),
                               lambda v: v >= seq_min AND v <= seq_max AND v > 0 AND (v - seq_min) % seq_step = 0 AND v >= 32768)
              ELSE [seq_max] END AS sizes,
         coalesce(CAST(list_max(list_filter(list_transform(version_keys, lambda k: {parse_int_sql('k')}),
                                            lambda v: v IS NOT NULL)) AS VARCHAR), '1') AS version
  FROM inventory)
, inv3 AS (
  SELECT artifact, dyn AND has_values AS is_dynamic, version,
         CASE WHEN dyn AND has_values
                THEN flatten(list_transform(sizes, lambda s: list_transform(bs_values,
                       lambda b: {{'ss': {size_text_sql('s')}, 'bs': CAST(b AS VARCHAR)}})))
              WHEN dyn AND static_batch
                THEN [{{'ss': {size_text_sql('seq_max')}, 'bs': CAST(batch_size AS VARCHAR)}}]
              WHEN NOT dyn AND p_ss <> '' AND p_bs <> ''
                THEN [{{'ss': {size_text_sql('CAST(p_ss AS BIGINT)')}, 'bs': CAST(CAST(p_bs AS BIGINT) AS VARCHAR)}}]
         END AS entries
  FROM inv2)
, configs AS (
  SELECT artifact, is_dynamic, CAST(entry_pos - 1 AS INTEGER) AS entry_pos, e.ss AS ss, e.bs AS bs, version
  FROM (SELECT artifact, is_dynamic, version, unnest(entries) AS e, generate_subscripts(entries, 1) AS entry_pos
        FROM inv3 WHERE entries IS NOT NULL))
"""

_PREC_SQL = """
, dyn_models AS (SELECT DISTINCT model FROM mapping
                 WHERE contains(artifact, 'dyt') AND artifact IN (SELECT artifact FROM configs))
, dropped AS (SELECT DISTINCT artifact FROM mapping
              WHERE model IN (SELECT model FROM dyn_models) AND NOT contains(artifact, 'dyt'))
, pconfigs AS (SELECT * FROM configs WHERE artifact NOT IN (SELECT artifact FROM dropped))
, mcfg AS (SELECT m.model, m.pos, m.artifact, c.entry_pos, c.ss, c.bs, c.version, c.is_dynamic
           FROM mapping m JOIN pconfigs c ON m.artifact = c.artifact)
"""

BASE = V5_SQL + _CONFIGS_SQL


_SNAPSHOTS: dict = {}


def catalog_snapshot(spark, sf_dir, name, build):
    """The derived catalog (mapping, inventory, configs after precedence) is
    written once per session and data folder to the shared checkpoint folder
    and every catalog query reads it, as the reference writes its config and
    mapping files once and reads them in every later step. ``checkpoint()``
    cuts the lineage, so later plans stay small and a lost executor re-reads
    files instead of recomputing the chain."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = build().checkpoint(eager=True)
    return _SNAPSHOTS[key]


def _base(spark, sf_dir):
    mapping = catalog_snapshot(spark, sf_dir, "mapping", lambda: v5_model_artifacts(spark, sf_dir))
    inv = catalog_snapshot(spark, sf_dir, "inventory", lambda: v5_inventory(spark, sf_dir))
    cfg = catalog_snapshot(spark, sf_dir, "configs", lambda: C.expand_configs(inv))
    return mapping, inv, cfg


def _pconfigs(spark, sf_dir):
    mapping, inv, cfg = _base(spark, sf_dir)
    p = catalog_snapshot(
        spark, sf_dir, "pconfigs", lambda: C.apply_precedence(cfg, mapping.select("model", "artifact"))
    )
    return mapping, inv, p


@register(
    "h23_h24_h26_h27_d12_expand_configs",
    BASE + "SELECT artifact, is_dynamic, entry_pos, ss, bs, version FROM configs",
)
def h23_h24_h26_h27_d12_expand_configs(spark, sf_dir):
    """H23 name parse, H24 size text, H26 halving sizes, H27 expansion, D12 version."""
    _, _, cfg = _base(spark, sf_dir)
    return cfg


@register(
    "c23_apply_precedence",
    BASE + _PREC_SQL + "SELECT artifact, entry_pos, ss, bs FROM pconfigs",
)
def c23_apply_precedence(spark, sf_dir):
    _, _, p = _pconfigs(spark, sf_dir)
    return p.select("artifact", "entry_pos", "ss", "bs")


@register(
    "c24_fill_model_type",
    BASE
    + """
SELECT c.model, c.path, coalesce(c.model_type, f.task) AS model_type
FROM checkpoints c LEFT JOIN (
  SELECT m.model, arg_min(i.task_name, m.pos) AS task
  FROM mapping m JOIN inventory i ON m.artifact = i.artifact GROUP BY m.model) f ON c.model = f.model
""",
)
def c24_fill_model_type(spark, sf_dir):
    mapping, inv, _ = _base(spark, sf_dir)
    ck = C.fill_model_type(v5_checkpoints(spark, sf_dir), mapping.select("model", "pos", "artifact"), inv)
    return ck.select("model", "path", "model_type")


@register(
    "c12_available_models",
    BASE
    + _PREC_SQL
    + """
SELECT model FROM checkpoints
WHERE coalesce(path <> '', true)
  AND model IN (SELECT model FROM mapping WHERE artifact IN (SELECT artifact FROM pconfigs))
ORDER BY model
""",
)
def c12_available_models(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    return C.available_models(v5_checkpoints(spark, sf_dir), mapping, p)


@register(
    "c13_model_configs",
    BASE + _PREC_SQL + "SELECT model, pos, artifact, entry_pos, ss, bs, version FROM mcfg",
)
def c13_model_configs(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    return C.order_configs(C.model_configs(mapping.select("model", "pos", "artifact"), p)).select(
        "model", "pos", "artifact", "entry_pos", "ss", "bs", "version"
    )


@register(
    "c14_model_configs_fallback",
    BASE
    + _PREC_SQL
    + f"""
SELECT m.model, m.pos, m.artifact, coalesce(c.entry_pos, 0) AS entry_pos,
       CASE WHEN c.version IS NULL THEN {size_text_sql("CAST(regexp_extract(m.artifact, 'ss(\\d+)-bs(\\d+)', 1) AS BIGINT)")} ELSE c.ss END AS ss,
       CASE WHEN c.version IS NULL THEN regexp_extract(m.artifact, 'ss(\\d+)-bs(\\d+)', 2) ELSE c.bs END AS bs,
       coalesce(c.version, '1') AS version
FROM mapping m LEFT JOIN pconfigs c ON m.artifact = c.artifact
WHERE c.version IS NOT NULL OR regexp_extract(m.artifact, 'ss(\\d+)-bs(\\d+)', 1) <> ''
""",
)
def c14_model_configs_fallback(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    return C.model_configs(mapping.select("model", "pos", "artifact"), p, fallback=True).select(
        "model", "pos", "artifact", "entry_pos", "ss", "bs", "version"
    )


@register(
    "d13_f3_distinct_configs",
    BASE + _PREC_SQL + f"SELECT DISTINCT model, ss, bs FROM mcfg ORDER BY {size_num_sql('ss')}, CAST(bs AS BIGINT), model",
)
def d13_f3_distinct_configs(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    return C.order_configs(C.distinct_configs(C.model_configs(mapping.select("model", "pos", "artifact"), p)))


@register(
    "b16_speculation_support",
    V5_SQL
    + """
SELECT model,
       bool_and(len(list_filter(string_split(artifact, '-'), lambda p: regexp_full_match(p, 'sd\\d+'))) > 0) AS supports_all,
       bool_or(len(list_filter(string_split(artifact, '-'), lambda p: regexp_full_match(p, 'sd\\d+'))) > 0) AS supports_any,
       bool_and(regexp_matches(artifact, '-sd\\d+')) AS required
FROM mapping GROUP BY model
""",
)
def b16_speculation_support(spark, sf_dir):
    return C.speculation_support(v5_model_artifacts(spark, sf_dir))


# ---------------------------------------------------------------- selections
_SEL_SQL = """
, drafts AS (SELECT 'model-b' || CAST(n % 25 + 1 AS VARCHAR) AS draft_model, 'model-b' || CAST(n AS VARCHAR) AS model
             FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS n FROM part) WHERE n % 2 = 0)
, targets AS (SELECT DISTINCT model, ss, bs FROM mcfg WHERE bs = '1' AND model IN (SELECT model FROM drafts))
, wanted AS (
  SELECT d.draft_model AS model, t.ss, t.bs, t.model AS draft_for FROM targets t JOIN drafts d ON t.model = d.model
  WHERE NOT EXISTS (SELECT 1 FROM targets x WHERE x.model = d.draft_model AND x.ss = t.ss AND x.bs = t.bs))
, matched AS (
  SELECT w.model, w.ss, w.bs, w.draft_for, arg_min(c.artifact, (c.pos, c.entry_pos)) AS artifact,
         arg_min(c.version, (c.pos, c.entry_pos)) AS version
  FROM wanted w JOIN mcfg c ON c.model = w.model AND c.ss = w.ss AND c.bs = w.bs
  GROUP BY w.model, w.ss, w.bs, w.draft_for)
, target_sel AS (
  SELECT model, ss, bs, arg_min(artifact, (pos, entry_pos)) AS artifact, arg_min(version, (pos, entry_pos)) AS version,
         CAST(NULL AS VARCHAR) AS draft_for
  FROM mcfg WHERE bs = '1' AND model IN (SELECT model FROM drafts) GROUP BY model, ss, bs)
, selections AS (SELECT * FROM target_sel UNION ALL SELECT model, ss, bs, artifact, version, draft_for FROM matched)
"""


def _drafts(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("n")
    b = p.select(n).distinct().where(F.col("n") % 2 == 0)
    return b.select(
        F.concat(F.lit("model-b"), F.col("n").cast("string")).alias("model"),
        F.concat(F.lit("model-b"), (F.col("n") % 25 + 1).cast("string")).alias("draft_model"),
    )


def _selections(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    mcfg = catalog_snapshot(
        spark, sf_dir, "model_configs", lambda: C.model_configs(mapping.select("model", "pos", "artifact"), p)
    )
    drafts = _drafts(spark, sf_dir)
    chosen = mcfg.where(F.col("bs") == "1").join(drafts.select("model"), "model", "left_semi")
    targets = chosen.select("model", "ss", "bs").distinct()
    matched = catalog_snapshot(spark, sf_dir, "matched", lambda: C.match_drafts(targets, drafts, mapping, mcfg))

    def selections():
        target_sel = (
            chosen.groupBy("model", "ss", "bs")
            .agg(F.min_by(F.struct("artifact", "version"), F.struct("pos", "entry_pos")).alias("_m"))
            .select("model", "ss", "bs", "_m.artifact", "_m.version", F.lit(None).cast("string").alias("draft_for"))
        )
        return target_sel.unionByName(matched)

    return mcfg, targets, matched, catalog_snapshot(spark, sf_dir, "selections", selections)


@register("c15_match_drafts", BASE + _PREC_SQL + _SEL_SQL + "SELECT model, ss, bs, artifact, version, draft_for FROM matched")
def c15_match_drafts(spark, sf_dir):
    _, _, matched, _ = _selections(spark, sf_dir)
    return matched


@register(
    "c16_missing_drafts",
    BASE
    + _PREC_SQL
    + _SEL_SQL
    + """
SELECT s.model, s.ss, s.bs, s.artifact || '-sd5' AS artifact
FROM (SELECT * REPLACE (CASE WHEN length(ss) % 2 = 0 THEN '99' ELSE bs END AS bs) FROM selections) s
WHERE s.draft_for IS NULL AND NOT EXISTS (SELECT 1 FROM selections d WHERE d.draft_for = s.model AND d.ss = s.ss AND d.bs = s.bs)
""",
)
def c16_missing_drafts(spark, sf_dir):
    """Beside every selection one of a speculative artifact, some of a
    batch size that has no draft."""
    _, _, _, sel = _selections(spark, sf_dir)
    speculative = sel.where("draft_for IS NULL").withColumn("artifact", F.concat("artifact", F.lit("-sd5"))).withColumn("bs", F.when(F.length("ss") % 2 == 0, F.lit("99")).otherwise(F.col("bs")))
    return C.missing_drafts(sel.unionByName(speculative)).select("model", "ss", "bs", "artifact")


@register(
    "c26_replace_selections",
    BASE
    + _PREC_SQL
    + _SEL_SQL
    + """
SELECT model, ss, bs, artifact FROM selections WHERE model <> 'model-b2' AND coalesce(draft_for <> 'model-b2', true)
UNION ALL
SELECT model, ss, bs, arg_min(artifact, (pos, entry_pos)) FROM mcfg WHERE model = 'model-b2' AND bs = '2' GROUP BY model, ss, bs
""",
)
def c26_replace_selections(spark, sf_dir):
    mcfg, _, _, sel = _selections(spark, sf_dir)
    new = (
        mcfg.where((F.col("model") == "model-b2") & (F.col("bs") == "2"))
        .groupBy("model", "ss", "bs")
        .agg(F.min_by("artifact", F.struct("pos", "entry_pos")).alias("artifact"))
    )
    return C.replace_selections(sel, "model-b2", new).select("model", "ss", "bs", "artifact")


@register(
    "d24_all_selected",
    BASE
    + _PREC_SQL
    + _SEL_SQL
    + """
SELECT c.model, bool_and(s.model IS NOT NULL) AND count(*) > 0 AS all_selected
FROM (SELECT DISTINCT model, ss, bs FROM mcfg) c
LEFT JOIN (SELECT DISTINCT model, ss, bs FROM mcfg WHERE bs = '1' AND model IN (SELECT model FROM drafts)) s
  ON c.model = s.model AND c.ss = s.ss AND c.bs = s.bs
GROUP BY c.model
""",
)
def d24_all_selected(spark, sf_dir):
    mcfg, targets, _, _ = _selections(spark, sf_dir)
    return C.all_selected(mcfg, targets)


@register(
    "d8_mode_first",
    BASE
    + _PREC_SQL
    + """
SELECT model, arg_min(ss, (-n, p)) AS ss FROM (
  SELECT model, ss, count(*) AS n, min((pos, entry_pos)) AS p FROM mcfg GROUP BY model, ss) GROUP BY model
""",
)
def d8_mode_first(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    mcfg = C.model_configs(mapping.select("model", "pos", "artifact"), p)
    # encounter order: list position, then the entry inside a dynamic artifact
    return C.mode_first(mcfg, ["model"], "ss", F.struct("pos", "entry_pos"))


@register(
    "d9_group_selections",
    BASE
    + _PREC_SQL
    + _SEL_SQL
    + f"""
SELECT model, count(*) AS n_experts,
       string_agg(ss || '=' || cfgs, ';' ORDER BY {size_num_sql('ss')}, ss) AS layout
FROM (SELECT model, ss, string_agg(artifact || ':' || version || '/' || bs, ',' ORDER BY artifact, version, bs) AS cfgs
      FROM selections GROUP BY model, ss)
GROUP BY model
""",
)
def d9_group_selections(spark, sf_dir):
    _, _, _, sel = _selections(spark, sf_dir)
    g = C.group_selections(sel.withColumn("pos", F.concat_ws("|", "artifact", "version", "bs")))
    expert_txt = F.transform(
        "experts",
        lambda e: F.concat(
            e["ss"],
            F.lit("="),
            F.array_join(F.transform(e["configs"], lambda c: F.concat(c["artifact"], F.lit(":"), c["version"], F.lit("/"), c["bs"])), ","),
        ),
    )
    return g.select("model", F.size("experts").cast("long").alias("n_experts"), F.array_join(expert_txt, ";").alias("layout"))


@register(
    "d10_merge_batch_sizes",
    BASE
    + _PREC_SQL
    + """
SELECT model, ss, artifact || ':' || version AS ref,
       array_to_string(list_sort(list_distinct(list(CAST(bs AS INTEGER)))), ',') AS batch_sizes
FROM mcfg WHERE is_dynamic GROUP BY model, ss, artifact || ':' || version
""",
)
def d10_merge_batch_sizes(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    mcfg = C.model_configs(mapping.select("model", "pos", "artifact"), p).where("is_dynamic")
    m = C.merge_batch_sizes(mcfg)
    return m.select("model", "ss", "ref", F.array_join("batch_sizes", ",").alias("batch_sizes"))


@register(
    "d11_draft_placement",
    BASE
    + _PREC_SQL
    + _SEL_SQL
    + """
, flagged AS (
  SELECT t.model, t.ss, t.bs,
         EXISTS (SELECT 1 FROM selections d JOIN drafts x ON x.draft_model = d.model
                 WHERE x.model = t.model AND d.ss = t.ss AND d.bs = t.bs) AS has_draft
  FROM target_sel t)
SELECT f.model, f.ss, d.draft_model, count(*) AS members,
       CASE WHEN bool_and(f.has_draft) AND count(*) > 1 THEN 'group_default' ELSE 'per_config' END AS placement
FROM flagged f JOIN drafts d ON f.model = d.model GROUP BY f.model, f.ss, d.draft_model
""",
)
def d11_draft_placement(spark, sf_dir):
    _, _, _, sel = _selections(spark, sf_dir)
    drafts = _drafts(spark, sf_dir)
    draft_sel = sel.select(F.col("model").alias("draft_model"), "ss", "bs").distinct().withColumn("has_draft", F.lit(True))
    targets = sel.where(F.col("draft_for").isNull()).select("model", "ss", "bs")
    flagged = (
        targets.join(drafts, "model", "left")
        .join(draft_sel, ["draft_model", "ss", "bs"], "left")
        .select("model", "ss", "bs", F.coalesce("has_draft", F.lit(False)).alias("has_draft"))
    )
    return C.draft_placement(flagged, drafts)


@register(
    "d16_rename_min_key",
    BASE
    + _PREC_SQL
    + f"""
, ck AS (SELECT c.model, coalesce(c.model_type, f.task) AS model_type FROM checkpoints c LEFT JOIN (
           SELECT m.model, arg_min(i.task_name, m.pos) AS task FROM mapping m JOIN inventory i ON m.artifact = i.artifact
           GROUP BY m.model) f ON c.model = f.model)
, g AS (SELECT DISTINCT model, ss FROM mcfg)
, mins AS (SELECT model, arg_min(ss, {size_num_sql('ss')}) AS min_ss FROM g GROUP BY model)
SELECT g.model, CASE WHEN coalesce(ck.model_type = 'embedding', false) AND g.ss = mins.min_ss THEN 'default' ELSE g.ss END AS ss
FROM g LEFT JOIN mins ON g.model = mins.model LEFT JOIN ck ON g.model = ck.model
""",
)
def d16_rename_min_key(spark, sf_dir):
    mapping, inv, p = _pconfigs(spark, sf_dir)
    m3 = mapping.select("model", "pos", "artifact")
    ck = C.fill_model_type(v5_checkpoints(spark, sf_dir), m3, inv)
    groups = C.model_configs(m3, p).select("model", "ss").distinct()
    return C.rename_min_key(groups, ck).select("model", "ss")


@register(
    "c27_resolve_refs",
    BASE
    + _PREC_SQL
    + f"""
, refs AS (
  SELECT model, CASE WHEN pos % 2 = 0 THEN 'default' ELSE ss END AS size_key, artifact || ':' || version AS ref,
         CASE WHEN is_dynamic THEN [CAST(bs AS INTEGER)] END AS batch_sizes FROM mcfg
  UNION ALL
  SELECT model, '4k', artifact || ':1', NULL FROM mapping WHERE p_type = 'ECONOMY'
  UNION ALL SELECT model, 'default', 'gone-' || artifact || ':2', CASE WHEN pos % 3 = 0 THEN [1, 8] ELSE [] END FROM mapping WHERE pos % 4 = 0)
, cmin AS (SELECT artifact, arg_min(ss, ({size_num_sql('ss')}, -entry_pos)) AS min_ss, arg_min(ss, entry_pos) AS first_ss, arg_min(bs, entry_pos) AS first_bs FROM pconfigs GROUP BY artifact)
, j AS (SELECT r.model, coalesce(len(batch_sizes), 0) > 0 AS listed, c.artifact IS NOT NULL AS known, r.size_key, c.min_ss, c.first_ss, c.first_bs,
               regexp_extract(r.ref, '^(.+):(\\d+)$', 1) AS artifact, regexp_extract(r.ref, '^(.+):(\\d+)$', 2) AS version, r.batch_sizes
        FROM refs r LEFT JOIN cmin c ON regexp_extract(r.ref, '^(.+):(\\d+)$', 1) = c.artifact)
SELECT model, CASE WHEN NOT listed THEN first_ss WHEN size_key = 'default' THEN coalesce(min_ss, size_key) ELSE size_key END AS ss, artifact, version, bs
FROM (SELECT *, unnest(CASE WHEN listed THEN list_transform(batch_sizes, lambda b: CAST(b AS VARCHAR)) ELSE [first_bs] END) AS bs FROM j WHERE listed OR known)
""",
)
def c27_resolve_refs(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    mcfg = C.model_configs(mapping.select("model", "pos", "artifact"), p)
    refs = mcfg.select(
        "model",
        F.when(F.col("pos") % 2 == 0, F.lit("default")).otherwise(F.col("ss")).alias("size_key"),
        F.concat("artifact", F.lit(":"), "version").alias("ref"),
        F.when(F.col("is_dynamic"), F.array(F.col("bs").cast("int"))).alias("batch_sizes"),
    ).unionByName(
        mapping.where(F.col("p_type") == "ECONOMY").select(
            "model",
            F.lit("4k").alias("size_key"),
            F.concat("artifact", F.lit(":1")).alias("ref"),
            F.lit(None).cast("array<int>").alias("batch_sizes"),
        )
    ).unionByName(
        mapping.where(F.col("pos") % 4 == 0).select(
            "model",
            F.lit("default").alias("size_key"),
            F.concat(F.lit("gone-"), "artifact", F.lit(":2")).alias("ref"),
            F.when(F.col("pos") % 3 == 0, F.array(F.lit(1), F.lit(8))).otherwise(F.array().cast("array<int>")).alias("batch_sizes"),
        )
    )
    return C.resolve_refs(refs, p)


# ---------------------------------------------------------------- catalog sets
@register(
    "c17_b11_catalog_diff",
    BASE
    + """
SELECT artifact, 'only_right' AS side FROM (SELECT DISTINCT artifact FROM mapping)
WHERE artifact NOT IN (SELECT artifact FROM inventory) AND NOT (ends_with(artifact, '-dev') OR ends_with(artifact, '-prod'))
UNION ALL
SELECT artifact, 'only_left' FROM inventory WHERE artifact NOT IN (SELECT artifact FROM mapping)
""",
)
def c17_b11_catalog_diff(spark, sf_dir):
    mapping, inv, _ = _base(spark, sf_dir)
    m = mapping.where(~K.excluded_suffix("artifact"))
    return C.catalog_diff(inv, m, "artifact")


@register(
    "c18_insert_absent",
    V5_SQL
    + """
, base AS (SELECT model FROM checkpoints WHERE path <> '')
, incoming AS (SELECT DISTINCT model FROM mapping)
SELECT count(*) FILTER (WHERE model NOT IN (SELECT model FROM base)) AS added,
       count(*) FILTER (WHERE model IN (SELECT model FROM base)) AS skipped
FROM incoming
""",
)
def c18_insert_absent(spark, sf_dir):
    base = v5_checkpoints(spark, sf_dir).where(F.col("path") != "").select("model")
    incoming = v5_model_artifacts(spark, sf_dir).select("model").distinct()
    _, counts = C.insert_absent(base, incoming, "model")
    return counts


@register(
    "c19_sync_replace",
    BASE
    + _PREC_SQL
    + """
, incoming AS (SELECT DISTINCT artifact FROM pconfigs)
SELECT coalesce(i.artifact, b.artifact) AS artifact,
       CASE WHEN i.artifact IS NULL THEN 'delete' WHEN b.artifact IS NULL THEN 'insert' ELSE 'update' END AS action
FROM incoming i FULL OUTER JOIN (SELECT artifact FROM inventory) b ON i.artifact = b.artifact
""",
)
def c19_sync_replace(spark, sf_dir):
    _, inv, p = _pconfigs(spark, sf_dir)
    incoming = p.select("artifact").distinct()
    return C.sync_replace(inv.select("artifact"), incoming, "artifact")


@register(
    "g3_common_keys",
    BASE + _PREC_SQL + "SELECT artifact FROM inventory INTERSECT SELECT artifact FROM pconfigs",
)
def g3_common_keys(spark, sf_dir):
    _, inv, p = _pconfigs(spark, sf_dir)
    return C.common_keys(inv, p, "artifact")


@register(
    "g4_key_difference",
    BASE + _PREC_SQL + "SELECT model, pos, artifact FROM mapping WHERE artifact NOT IN (SELECT artifact FROM pconfigs)",
)
def g4_key_difference(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    return C.key_difference(mapping.select("model", "pos", "artifact"), p, "artifact")


@register(
    "e8_first_match",
    BASE + _PREC_SQL + "SELECT model, ss, arg_min(artifact, (pos, entry_pos)) AS artifact FROM mcfg GROUP BY model, ss",
)
def e8_first_match(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    mcfg = C.model_configs(mapping.select("model", "pos", "artifact"), p).withColumn("_p", F.struct("pos", "entry_pos"))
    return C.first_match(mcfg, ["model", "ss"], "artifact", "_p")


@register(
    "e10_last_entry",
    "SELECT p_brand, arg_max(p_partkey, p_partkey) AS p_partkey, arg_max(p_name, p_partkey) AS p_name, "
    "arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand",
)
def e10_last_entry(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    return C.last_entry(p.withColumn("_o", F.col("p_partkey")), "p_brand", "_o").drop("_o")


@register(
    "f4_order_ci",
    "SELECT DISTINCT p_name FROM part ORDER BY lower(p_name), p_name",
)
def f4_order_ci(spark, sf_dir):
    return C.order_ci(read_table(spark, sf_dir, "part").select("p_name").distinct(), "p_name")


_VERSIONS_SQL = """
, versions AS (SELECT model, CAST(p_size % 3 AS VARCHAR) || '.' || CAST(p_partkey % 4 AS VARCHAR)
                      || CASE WHEN p_size % 5 = 0 THEN '.0' ELSE '' END
                      || CASE WHEN p_partkey % 6 = 0 THEN '.0.0.0.0.0.0.' || CAST(p_partkey % 5 - 2 AS VARCHAR) ELSE '' END AS version, pos FROM mapping)
, overrides AS (SELECT model, CASE WHEN n % 2 = 0 THEN '1.1' ELSE '9.9' END AS version
                FROM (SELECT DISTINCT model, CAST(regexp_extract(model, '(\\d+)', 1) AS BIGINT) AS n FROM mapping) WHERE n % 3 = 0)
"""


def _versions(spark, sf_dir):
    m = v5_model_artifacts(spark, sf_dir)
    versions = m.select(
        "model",
        F.concat(
            (F.col("p_size") % 3).cast("string"),
            F.lit("."),
            (F.col("p_partkey") % 4).cast("string"),
            F.when(F.col("p_size") % 5 == 0, F.lit(".0")).otherwise(F.lit("")),
            F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit(".0.0.0.0.0.0."), (F.col("p_partkey") % 5 - 2).cast("string"))).otherwise(F.lit("")),
        ).alias("version"),
        "pos",
    )
    n = F.regexp_extract("model", r"(\d+)", 1).cast("long")
    overrides = (
        m.select("model").distinct().where(n % 3 == 0)
        .select("model", F.when(n % 2 == 0, F.lit("1.1")).otherwise(F.lit("9.9")).alias("version"))
    )
    return versions, overrides


def _vkey_sql(v: str) -> str:
    parts = f"list_transform(string_split({v}, '.'), lambda p: coalesce(TRY_CAST(trim(p) AS DOUBLE), 0))"
    return f"(list_concat({parts}, list_transform(range(0, 16), lambda i: 0)))[1:16]"  # of at most 10 parts in these data


@register(
    "c22_f8_choose_version",
    V5_SQL
    + _VERSIONS_SQL
    + f"""
, best AS (SELECT model, arg_max(version, ({_vkey_sql('version')}, pos)) AS best FROM versions GROUP BY model)
SELECT b.model,
       CASE WHEN o.version IS NOT NULL AND EXISTS (SELECT 1 FROM versions v WHERE v.model = b.model AND v.version = o.version)
            THEN o.version ELSE b.best END AS version
FROM best b LEFT JOIN overrides o ON b.model = o.model
""",
)
def c22_f8_choose_version(spark, sf_dir):
    versions, overrides = _versions(spark, sf_dir)
    return C.choose_version(versions, overrides.dropDuplicates(["model"]))


@register(
    "b19_checkpoint_rows",
    BASE
    + _PREC_SQL
    + """
, avail AS (SELECT model FROM checkpoints WHERE coalesce(path <> '', true)
            AND model IN (SELECT model FROM mapping WHERE artifact IN (SELECT artifact FROM pconfigs)))
, keyed AS (SELECT a.model, c.path, c.vision_embedding_checkpoint,
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(a.model), '[^A-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_', ''), '_$', '') AS base
            FROM avail a LEFT JOIN checkpoints c ON a.model = c.model)
SELECT model, base || '_CKPT' AS name, 'gs://bucket/' || coalesce(path, '') AS source FROM keyed
UNION ALL
SELECT model, regexp_replace(base, '_INSTRUCT$', '') || '_VISION_EMBD_CKPT', 'gs://bucket/' || vision_embedding_checkpoint
FROM keyed WHERE coalesce(vision_embedding_checkpoint, '') <> ''
""",
)
def b19_checkpoint_rows(spark, sf_dir):
    mapping, _, p = _pconfigs(spark, sf_dir)
    ck = v5_checkpoints(spark, sf_dir)
    avail = C.available_models(ck, mapping, p)
    return C.checkpoint_rows(avail, ck, "gs://bucket/")


@register(
    "h25_h33_h34_h35_h51_name_rules",
    V5_SQL
    + f"""
SELECT pos, {size_num_sql("(CAST(CAST(pow(2, 9 + p_size % 8) AS BIGINT) // 1024 AS VARCHAR) || 'k')")} AS size_value,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(model || '-' || p_type || '.' || artifact), '[^A-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_', ''), '_$', '') || '_CKPT' AS ckpt_key,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(model || '-Instruct'), '[^A-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_', ''), '_$', ''), '_INSTRUCT$', '') || '_VISION_EMBD_CKPT' AS vision_key,
       CASE WHEN starts_with(artifact, 'b-') THEN 'bd-' || substr(artifact, 3) ELSE 'bd-' || artifact END AS deployment,
       CASE WHEN regexp_matches(artifact || ':' || CAST(p_size AS VARCHAR), '^(.+):(\\d+)$')
            THEN regexp_extract(artifact || ':' || CAST(p_size AS VARCHAR), '^(.+):(\\d+)$', 2) END AS ref_version,
       coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE 'cfg-' || model END), ''),
                nullif(trim(CASE WHEN p_size % 2 = 0 THEN 'grp-' || model END), ''), 'model-default') AS draft
FROM mapping
""",
)
def h25_h33_h34_h35_h51_name_rules(spark, sf_dir):
    m = v5_model_artifacts(spark, sf_dir)
    size_txt = F.concat((F.pow(F.lit(2), F.lit(9) + F.col("p_size") % 8).cast("long") / 1024).cast("long").cast("string"), F.lit("k"))
    ref = K.parse_ref(F.concat("artifact", F.lit(":"), F.col("p_size").cast("string")))
    return m.select(
        "pos",
        K.size_num(size_txt).alias("size_value"),
        K.checkpoint_key(F.concat("model", F.lit("-"), "p_type", F.lit("."), "artifact")).alias("ckpt_key"),
        K.vision_key(F.concat("model", F.lit("-Instruct"))).alias("vision_key"),
        K.deployment_name("artifact").alias("deployment"),
        ref["version"].alias("ref_version"),
        K.pick_draft(
            F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("cfg-"), "model")),
            F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("grp-"), "model")),
            F.lit("model-default"),
        ).alias("draft"),
    )


@register(
    "h28_h29_versions",
    """
SELECT p_partkey,
       (list_concat(list_transform(string_split(CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR)
                                                || CASE WHEN p_partkey % 4 = 0 THEN '.0.0.0.0.0.0.0.' || CAST(p_partkey % 3 - 1 AS VARCHAR) ELSE '' END, '.'),
                                   lambda p: coalesce(TRY_CAST(trim(p) AS DOUBLE), 0)), list_transform(range(0, 16), lambda i: 0)))[1:16]
         > [1, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS newer_than_1_3,
       CASE WHEN regexp_extract(replace_first, '^(\\d+\\.\\d+\\.\\d+)', 1) <> '' THEN regexp_extract(replace_first, '^(\\d+\\.\\d+\\.\\d+)', 1)
            ELSE replace_first END AS chart_version,
       replace_first <> CASE WHEN regexp_extract(replace_first, '^(\\d+\\.\\d+\\.\\d+)', 1) <> ''
            THEN regexp_extract(replace_first, '^(\\d+\\.\\d+\\.\\d+)', 1) ELSE replace_first END AS has_suffix
FROM (SELECT *, CASE WHEN strpos(chart, 'stack-') > 0
                     THEN left(chart, strpos(chart, 'stack-') - 1) || substr(chart, strpos(chart, 'stack-') + 6) ELSE chart END AS replace_first
      FROM (SELECT *, 'stack-0.' || CAST(p_size % 5 AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR)
                       || CASE WHEN p_size % 4 = 0 THEN '-' || replace(p_name, ' ', '-') ELSE '' END AS chart FROM part))
""",
)
def h28_h29_versions(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    tenth = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(".0.0.0.0.0.0.0."), (F.col("p_partkey") % 3 - 1).cast("string"))).otherwise(F.lit(""))
    v = F.concat((F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), tenth)
    chart = F.concat(
        F.lit("stack-0."),
        (F.col("p_size") % 5).cast("string"),
        F.lit("."),
        F.col("p_partkey").cast("string"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("-"), F.regexp_replace("p_name", " ", "-"))).otherwise(F.lit("")),
    )
    cv = K.chart_version(chart, "stack-")
    return p.select(
        "p_partkey",
        (K.version_key(v) > K.version_key(F.lit("1.3"))).alias("newer_than_1_3"),
        cv["version"].alias("chart_version"),
        cv["has_suffix"].alias("has_suffix"),
    )


@register(
    "h31_h32_storage_roots",
    """
SELECT page_id,
       regexp_replace(regexp_replace(g, '^gs://[^/]+/', ''), '/$', '') AS stripped,
       CASE WHEN trim(r) = '' THEN ''
            WHEN regexp_matches(trim(r), '^gs://[^/]+', 'i') THEN 'gs://' || regexp_extract(trim(r), '^gs://([^/]+)', 1, 'i') || '/'
            WHEN ends_with(trim(r), '/') THEN trim(r) ELSE trim(r) || '/' END AS root,
       coalesce(regexp_matches(trim(r), '^gs://[^/]+', 'i')
                AND length(regexp_replace(substr(trim(r), length(regexp_extract(trim(r), '^(gs://[^/]+/?)', 1, 'i')) + 1), '/+$', '')) > 0, false) AS root_stripped,
       trim(r) <> '' AS root_valid
FROM (SELECT page_id, regexp_replace(url, '^https?://', 'gs://') AS g,
             CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', 'gs://') WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', '')
                  WHEN 2 THEN ' ' ELSE regexp_replace(url, '^https?://([^/]+).*$', 'gs://\\1') END AS r
      FROM pages)
""",
)
def h31_h32_storage_roots(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    g = F.regexp_replace("url", "^https?://", "gs://")
    r = (
        F.when(F.col("page_id") % 4 == 0, g)
        .when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^https?://[^/]+", ""))
        .when(F.col("page_id") % 4 == 2, F.lit(" "))
        .otherwise(F.regexp_replace("url", "^https?://([^/]+).*$", "gs://$1"))
    )
    root = K.normalize_root(r)
    return p.select(
        "page_id",
        K.strip_bucket(g).alias("stripped"),
        root["value"].alias("root"),
        root["stripped"].alias("root_stripped"),
        root["valid"].alias("root_valid"),
    )
