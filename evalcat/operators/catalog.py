"""Model-catalog operators (SURVEY C12-C27, D8-D13, D16, D18, D24, B12, B13,
B16, B17, B19, E7, E8, E10, F3, F4, F8, G3, G4, G6).

Inputs are long tables, one fact per row:
  model_artifacts(model, pos, artifact)            ordered artifact list per model
  inventory(artifact, version_keys, task_name, bs_values, batch_size,
            seq_min, seq_max, seq_step)             compiled artifacts on a cluster
  configs(artifact, is_dynamic, ss, bs, version)   one row per offered (ss, bs)
  checkpoints(model, path, resource_name, vision_embedding_checkpoint, model_type)
  selections(model, ss, bs, artifact, version, draft_for)

Every list rule of the reference ("first artifact in list order", "any/all
artifacts of a model") becomes a join plus ``min_by``/``bool_or``/
``bool_and`` over the list position: partial aggregates, so a model with a
huge artifact list is reduced map-side, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcat.functions import catalog as K
from evalcat.functions.text import strip


# --------------------------------------------------------------------------- #
# artifact configs
# --------------------------------------------------------------------------- #
def expand_configs(inventory: DataFrame) -> DataFrame:
    """H27 + H23 + D12: one row per offered (artifact, ss, bs).

    Static artifacts: (ss, bs) parsed from the name (skipped when it does not
    parse). Dynamic (``dyt``) artifacts: halving sizes x listed batch sizes
    (a single max size when min/step are missing; skipped when no size
    survives), or one entry for a static batch size; otherwise skipped."""
    version = K.latest_version("version_keys")
    dyn = K.is_dynamic("artifact")
    sizes = F.when(
        F.col("seq_min").isNotNull() & F.col("seq_step").isNotNull(),
        K.halving_sizes("seq_min", "seq_max", "seq_step"),
    ).otherwise(F.array(F.col("seq_max").cast("long")))
    has_values = F.col("bs_values").isNotNull() & (F.size("bs_values") > 0) & F.col("seq_max").isNotNull()
    static_batch = F.col("batch_size").isNotNull() & F.col("seq_max").isNotNull()
    parsed = K.parse_artifact("artifact")
    entries = (
        F.when(
            dyn & has_values,
            F.flatten(
                F.transform(
                    sizes,
                    lambda s: F.transform(
                        F.col("bs_values"),
                        lambda b: F.struct(K.size_text(s).alias("ss"), b.cast("string").alias("bs")),
                    ),
                )
            ),
        )
        .when(
            dyn & static_batch,
            F.array(F.struct(K.size_text(F.col("seq_max")).alias("ss"), F.col("batch_size").cast("string").alias("bs"))),
        )
        .when(
            ~dyn & parsed.isNotNull(),
            F.array(F.struct(K.size_text(parsed["ss"]).alias("ss"), parsed["bs"].cast("string").alias("bs"))),
        )
    )
    out = inventory.select(
        "artifact",
        # a dynamic artifact with a static batch size is stored as one plain entry
        (dyn & has_values).alias("is_dynamic"),
        version.alias("version"),
        F.posexplode(entries).alias("entry_pos", "e"),
    )
    return out.select("artifact", "is_dynamic", "entry_pos", F.col("e.ss").alias("ss"), F.col("e.bs").alias("bs"), "version")


def apply_precedence(configs: DataFrame, mapping: DataFrame) -> DataFrame:
    """When a model's list has a configured dynamic artifact, its
    non-dynamic artifacts are dropped from the configs, globally (a shared
    artifact disappears for every model)."""
    configured = configs.select("artifact").distinct()
    models_with_dyn = (
        mapping.where(K.is_dynamic("artifact")).join(configured, "artifact", "left_semi").select("model").distinct()
    )
    drop = (
        mapping.join(models_with_dyn, "model", "left_semi")
        .where(~K.is_dynamic("artifact"))
        .select("artifact")
        .distinct()
    )
    return configs.join(drop, "artifact", "left_anti")


def fill_model_type(checkpoints: DataFrame, mapping: DataFrame, inventory: DataFrame) -> DataFrame:
    """A model without model_type takes the task_name of the FIRST
    artifact of its list that exists in the inventory (if that one has a
    task name); models with a type keep it."""
    first = (
        mapping.join(inventory.select("artifact", "task_name"), "artifact", "inner")
        .groupBy("model")
        .agg(F.min_by("task_name", "pos").alias("_task"))
    )
    return (
        checkpoints.join(first, "model", "left")
        .withColumn("model_type", F.coalesce(F.col("model_type"), F.col("_task")))
        .drop("_task")
    )


def available_models(checkpoints: DataFrame, mapping: DataFrame, configs: DataFrame) -> DataFrame:
    """Models with a checkpoint path that is not "", a non-empty artifact
    list, and at least one listed artifact that has a config. Sorted."""
    ok_ckpt = checkpoints.where(F.coalesce(F.col("path") != "", F.lit(True))).select("model")
    has_cfg = mapping.join(configs.select("artifact").distinct(), "artifact", "left_semi").select("model").distinct()
    return ok_ckpt.join(has_cfg, "model", "left_semi").orderBy("model")


def model_configs(
    mapping: DataFrame, configs: DataFrame, fallback: bool = False, models: DataFrame | None = None
) -> DataFrame:
    """C13 (+ C14 when ``fallback``): model -> artifact -> config entries.
    With fallback, a listed artifact without configs is parsed from its name
    (``ss(\\d+)-bs(\\d+)``) with version "1"."""
    m = mapping if models is None else mapping.join(models.select("model"), "model", "left_semi")
    joined = m.join(configs, "artifact", "left" if fallback else "inner")
    if fallback:
        ss = F.regexp_extract("artifact", r"ss(\d+)-bs(\d+)", 1)
        bs = F.regexp_extract("artifact", r"ss(\d+)-bs(\d+)", 2)
        missing = F.col("version").isNull()
        joined = joined.where(~missing | (ss != "")).select(
            "model",
            "pos",
            "artifact",
            F.coalesce(F.col("entry_pos"), F.lit(0)).alias("entry_pos"),
            F.when(missing, K.size_text(ss.cast("long"))).otherwise(F.col("ss")).alias("ss"),
            F.when(missing, bs).otherwise(F.col("bs")).alias("bs"),
            F.coalesce(F.col("version"), F.lit("1")).alias("version"),
            F.coalesce(F.col("is_dynamic"), F.lit(False)).alias("is_dynamic"),
        )
    return joined


def distinct_configs(model_cfgs: DataFrame) -> DataFrame:
    """Distinct (model, ss, bs)."""
    return model_cfgs.select("model", "ss", "bs").dropDuplicates()


def order_configs(df: DataFrame) -> DataFrame:
    """by size value (``4k`` = 4096, the CLI rule) then batch size."""
    return df.orderBy(K.size_num(F.col("ss")), K.js_parse_int(F.col("bs")), "model")


def speculation_support(mapping: DataFrame) -> DataFrame:
    """B16 per model: supports_all (every artifact speculative, the UI rule),
    supports_any (the CLI rule), required (every artifact matches -sd<n>)."""
    return mapping.groupBy("model").agg(
        F.bool_and(K.is_speculative("artifact")).alias("supports_all"),
        F.bool_or(K.is_speculative("artifact")).alias("supports_any"),
        F.bool_and(F.col("artifact").rlike(r"-sd\d+")).alias("required"),
    )


def match_drafts(
    targets: DataFrame, drafts: DataFrame, mapping: DataFrame, model_cfgs: DataFrame
) -> DataFrame:
    """For every selected (target, ss, bs) with an assigned draft model,
    the FIRST artifact (list order) of the draft model offering the same
    (ss, bs), unless the draft already has that (ss, bs) selected.

    targets(model, ss, bs), drafts(model, draft_model); ``model_cfgs`` from
    :func:`model_configs`. One row per target config that found a match."""
    wanted = targets.join(drafts, "model", "inner").select(
        F.col("draft_model").alias("model"), "ss", "bs", F.col("model").alias("draft_for")
    )
    already = targets.select("model", "ss", "bs")
    wanted = wanted.join(already, ["model", "ss", "bs"], "left_anti")
    cand = model_cfgs.select("model", "pos", "entry_pos", "artifact", "ss", "bs", "version")
    hits = wanted.join(cand, ["model", "ss", "bs"], "inner")
    return hits.groupBy("model", "ss", "bs", "draft_for").agg(
        F.min_by(F.struct("artifact", "version"), F.struct("pos", "entry_pos")).alias("_m")
    ).select("model", "ss", "bs", "_m.artifact", "_m.version", "draft_for")


def missing_drafts(selections: DataFrame) -> DataFrame:
    """Speculative selections (not themselves drafts) with no draft
    selection for the same (model, ss, bs)."""
    drafts = selections.where(F.col("draft_for").isNotNull()).select(
        F.col("draft_for").alias("model"), "ss", "bs"
    )
    spec = selections.where(F.col("draft_for").isNull() & F.col("artifact").rlike(r"-sd\d+"))
    return spec.join(drafts, ["model", "ss", "bs"], "left_anti")


def catalog_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """C17: keys only in a and only in b, in one pass (full outer join on the
    key, flag column ``side``)."""
    ka = a.select(F.col(key).alias(key)).distinct().withColumn("_a", F.lit(True))
    kb = b.select(F.col(key).alias(key)).distinct().withColumn("_b", F.lit(True))
    j = ka.join(kb, key, "full_outer")
    return j.where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        key, F.when(F.col("_b").isNull(), F.lit("only_left")).otherwise(F.lit("only_right")).alias("side")
    )


def insert_absent(base: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Add rows whose key is absent. Returns (merged, counts) where counts
    has added and skipped."""
    added = new.join(base.select(key), key, "left_anti")
    merged = base.unionByName(added, allowMissingColumns=True)
    flagged = new.join(base.select(key).distinct().withColumn("_dup", F.lit(True)), key, "left")
    counts = flagged.agg(
        F.count(F.when(F.col("_dup").isNull(), 1)).alias("added"),
        F.count(F.when(F.col("_dup"), 1)).alias("skipped"),
    )
    return merged, counts


def sync_replace(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Full-sync replace: keys missing from incoming are deleted, present
    ones upserted, new ones inserted. Output = incoming rows + ``action``
    (insert/update) plus deleted keys (action delete). Raises on duplicate
    incoming names (D22 guard)."""
    dup = incoming.groupBy(key).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"duplicate {key} in incoming rows")
    b = base.select(key).distinct().withColumn("_old", F.lit(True))
    i = incoming.withColumn("_new", F.lit(True))
    j = i.join(b, key, "full_outer")
    return j.select(
        *[F.col(c) for c in incoming.columns],  # the key comes from either side
        F.when(F.col("_new").isNull(), F.lit("delete"))
        .when(F.col("_old").isNull(), F.lit("insert"))
        .otherwise(F.lit("update"))
        .alias("action"),
    )


def choose_version(versions: DataFrame, overrides: DataFrame) -> DataFrame:
    """C22 + F8: per model, the override version when that version exists,
    else the highest version (part-wise numeric compare; among equal keys
    the later listed one). versions(model, version, pos, ...)."""
    ranked = versions.withColumn("_vk", K.version_key("version"))
    best = ranked.groupBy("model").agg(F.max_by("version", F.struct("_vk", "pos")).alias("_best"))
    ov = overrides.select("model", F.col("version").alias("_ov"))
    exists = versions.select("model", F.col("version").alias("_ov")).distinct().withColumn("_has", F.lit(True))
    chosen = best.join(ov, "model", "left").join(exists, ["model", "_ov"], "left")
    return chosen.select(
        "model", F.when(F.col("_has"), F.col("_ov")).otherwise(F.col("_best")).alias("version")
    )


def replace_selections(selections: DataFrame, model: str, new: DataFrame) -> DataFrame:
    """Drop a model's selections and the drafts made for it, then add
    the new ones."""
    keep = selections.where((F.col("model") != model) & F.coalesce(F.col("draft_for") != model, F.lit(True)))
    return keep.unionByName(new, allowMissingColumns=True)


def keep_chosen(selections: DataFrame, chosen_models: DataFrame) -> DataFrame:
    """Keep selections of models still chosen."""
    return selections.join(chosen_models.select("model"), "model", "left_semi")


def resolve_refs(refs: DataFrame, configs: DataFrame, strict: bool = False) -> DataFrame:
    """Manifest references ``artifact:version`` per (model, size key) to
    selections (model, ss, artifact, version, bs).

    With listed batch sizes, a row each, of the size key itself; the key
    ``default`` stands for the smallest configured size of the artifact (of
    equal ones the last), and stays as it is without a configuration. Without
    batch sizes, size and batch size are those of the artifact's first entry
    (``entry_pos``); an artifact without one is skipped, or an error when
    ``strict``. A reference of another form is always an error.

    refs(model, size_key, ref, batch_sizes array<int> or null);
    configs(artifact, entry_pos, ss, bs)."""
    parsed = refs.withColumn("_r", K.parse_ref("ref"))
    bad = parsed.where(~F.coalesce(F.col("_r.valid"), F.lit(False))).agg(F.min("ref")).first()[0]
    if bad is not None:
        raise ValueError(f'Invalid artifact reference: "{bad}" (expecting "name:version")')
    entries = configs.groupBy(F.col("artifact").alias("_artifact")).agg(
        F.min_by("ss", F.struct(K.size_num(F.col("ss")).alias("n"), (-F.col("entry_pos")).alias("p"))).alias("_least"),
        F.min_by(F.struct("ss", "bs"), "entry_pos").alias("_first"),
    )
    j = parsed.join(entries, F.col("_r.name") == F.col("_artifact"), "left")
    listed = F.coalesce(F.size("batch_sizes") > 0, F.lit(False))
    if strict:
        unknown = j.where(~listed & F.col("_artifact").isNull()).agg(F.min("_r.name")).first()[0]
        if unknown is not None:
            raise ValueError(f'Artifact "{unknown}" not found in the configuration')
    dynamic = F.struct(
        F.when(F.col("size_key") == "default", F.coalesce("_least", "size_key")).otherwise(F.col("size_key")).alias("ss"), F.transform("batch_sizes", lambda b: b.cast("string")).alias("bs")
    )
    plain = F.struct(F.col("_first.ss").alias("ss"), F.array("_first.bs").alias("bs"))
    out = j.where(listed | F.col("_artifact").isNotNull()).withColumn("_s", F.when(listed, dynamic).otherwise(plain))
    return out.select("model", F.col("_s.ss").alias("ss"), F.col("_r.name").alias("artifact"), F.col("_r.version").alias("version"), F.explode("_s.bs").alias("bs"))


def mode_first(df: DataFrame, group_cols: Sequence[str], value_col: str, pos_col: str | Column) -> DataFrame:
    """Most common value per group, ties to the value seen first.
    ``pos_col`` is the encounter order (any orderable type, e.g. a struct of
    list position and entry position); it must be unique within a group."""
    pos = F.col(pos_col) if isinstance(pos_col, str) else pos_col
    counts = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_p"))
    return counts.groupBy(*group_cols).agg(
        F.min_by(value_col, F.struct((-F.col("_n")).alias("n"), F.col("_p").alias("p"))).alias(value_col)
    )


def group_selections(selections: DataFrame) -> DataFrame:
    """Nested model -> size -> ordered configs. Inner lists are bounded
    by one model's selections; ordering by explicit position."""
    per_ss = selections.groupBy("model", "ss").agg(
        F.array_sort(F.collect_list(F.struct("pos", "artifact", "version", "bs"))).alias("configs")
    )
    return per_ss.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct(K.size_num(F.col("ss")).alias("ss_num"), "ss", "configs"))).alias("experts")
    )


def merge_batch_sizes(selections: DataFrame) -> DataFrame:
    """Dynamic selections merged per (model, ss, artifact:version) into
    one entry with the distinct batch sizes ascending."""
    return selections.groupBy("model", "ss", F.concat("artifact", F.lit(":"), "version").alias("ref")).agg(
        F.array_sort(F.collect_set(F.col("bs").cast("int"))).alias("batch_sizes")
    )


def draft_placement(selections: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per (model, ss) group: the draft goes to the group default when
    every member has a matching draft config AND there is more than one
    member; otherwise per config. selections: non-dynamic target rows with
    ``has_draft`` flag."""
    g = selections.join(drafts, "model", "inner").groupBy("model", "ss", "draft_model").agg(
        F.bool_and("has_draft").alias("_all"), F.count(F.lit(1)).alias("members")
    )
    return g.select(
        "model",
        "ss",
        "draft_model",
        "members",
        F.when(F.col("_all") & (F.col("members") > 1), F.lit("group_default")).otherwise(F.lit("per_config")).alias(
            "placement"
        ),
    )


def rename_min_key(groups: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For embedding models, the smallest size key becomes ``default``."""
    mins = groups.groupBy("model").agg(F.min_by("ss", K.size_num(F.col("ss"))).alias("_min"))
    emb = checkpoints.select("model", (F.col("model_type") == "embedding").alias("_emb"))
    j = groups.join(mins, "model", "left").join(emb, "model", "left")
    return j.withColumn(
        "ss", F.when(F.coalesce(F.col("_emb"), F.lit(False)) & (F.col("ss") == F.col("_min")), F.lit("default")).otherwise(F.col("ss"))
    ).drop("_min", "_emb")


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """Row counts per category."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def all_selected(model_cfgs: DataFrame, selections: DataFrame) -> DataFrame:
    """Per model, every distinct (ss, bs) config is selected; false for a
    model without configs (it has no row on the left, so it is added)."""
    cfg = model_cfgs.select("model", "ss", "bs").distinct()
    sel = selections.select("model", "ss", "bs").distinct().withColumn("_sel", F.lit(True))
    j = cfg.join(sel, ["model", "ss", "bs"], "left")
    return j.groupBy("model").agg(
        (F.bool_and(F.coalesce(F.col("_sel"), F.lit(False))) & (F.count(F.lit(1)) > 0)).alias("all_selected")
    )


def checkpoint_rows(models: DataFrame, checkpoints: DataFrame, root: str) -> DataFrame:
    """One checkpoint row per chosen model plus an extra row for a
    vision checkpoint; source = root + path."""
    j = models.select("model").join(checkpoints, "model", "left")
    base = F.struct(
        K.checkpoint_key(F.col("model")).alias("name"),
        F.concat(F.lit(root), F.coalesce(F.col("path"), F.lit(""))).alias("source"),
    )
    vision = F.when(
        F.coalesce(F.col("vision_embedding_checkpoint"), F.lit("")) != "",
        F.struct(
            K.vision_key(F.col("model")).alias("name"),
            F.concat(F.lit(root), F.col("vision_embedding_checkpoint")).alias("source"),
        ),
    )
    rows = F.explode(F.array_compact(F.array(base, vision)))
    return j.select("model", rows.alias("c")).select("model", "c.name", "c.source")


def first_match(df: DataFrame, keys: Sequence[str], value: str, pos: str) -> DataFrame:
    """First value per key by list position."""
    return df.groupBy(*keys).agg(F.min_by(value, pos).alias(value))


def last_entry(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last entry per key wins (whole row)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(key, "_r.*")


def order_ci(df: DataFrame, col: str) -> DataFrame:
    """case-insensitive sort (exact text breaks ties)."""
    return df.orderBy(F.lower(F.col(col)), F.col(col))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both."""
    return a.select(key).intersect(b.select(key))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b (duplicates kept)."""
    return a.join(b.select(key), key, "left_anti")


def allowed_modules(declared, safe, denied) -> Column:
    """(declared U safe) - denied, as arrays."""
    return F.array_except(F.array_union(declared, safe), denied)


def bundle_status(bundles: DataFrame) -> DataFrame:
    """Validity from the FIRST condition: reason ValidationSucceeded or
    status "True"; missing values default to Unknown / ""."""
    first = F.get(F.col("conditions"), 0)
    return bundles.select(
        "*",
        F.coalesce(first["status"], F.lit("Unknown")).alias("cond_status"),
        F.coalesce(first["reason"], F.lit("")).alias("cond_reason"),
        F.coalesce(first["message"], F.lit("")).alias("cond_message"),
        F.coalesce((first["reason"] == "ValidationSucceeded") | (first["status"] == "True"), F.lit(False)).alias("is_valid"),
    )


def error_lines(bundles: DataFrame) -> DataFrame:
    """Failed condition's message (ValidationFailed, or status False
    with a message), else all messages joined; split into trimmed non-blank
    lines, one row each with its line number. Without any message: a line
    ``type: reason \u2014 message`` for each condition."""
    failed = F.filter(
        "conditions",
        lambda c: (c["reason"] == "ValidationFailed") | ((c["status"] == "False") & (F.coalesce(c["message"], F.lit("")) != "")),
    )
    msg = F.coalesce(
        F.nullif(F.get(failed, 0)["message"], F.lit("")),
        F.array_join(F.filter(F.transform("conditions", lambda c: c["message"]), lambda m: F.coalesce(m, F.lit("")) != ""), "\n"),
    )
    lines = F.filter(F.transform(F.split(msg, "\n"), lambda x: strip(x)), lambda x: F.length(x) > 0)
    said = lambda c: F.coalesce(c, F.lit("undefined"))
    plain = F.transform("conditions", lambda c: F.concat(said(c["type"]), F.lit(": "), said(c["reason"]), F.lit(" \u2014 "), said(c["message"])))
    return bundles.select("name", F.posexplode(F.when(F.coalesce(msg, F.lit("")) != "", lines).otherwise(plain)).alias("line_no", "line"))


def only_ready(df: DataFrame, flag_col: str = "is_valid") -> DataFrame:
    """Keep ready rows (valid bundles / deployed deployments)."""
    return df.where(F.col(flag_col))


def pods_of(deployments: DataFrame, pods: DataFrame, anywhere: bool = False) -> DataFrame:
    """Pods of a deployment by name prefix ``inf-<deployment>-`` (or the
    deployment name anywhere in the pod name). A prefix rule cannot be an
    equi-join on the full name, so the prefix candidates are enumerated:
    every ``inf-<x>-`` prefix of a pod name is a candidate deployment key,
    which turns the theta join into an equi join (a name that prefixes
    another matches both, as in the reference)."""
    if anywhere:
        # substring rule: a pod name holds at most len(name)^2 substrings; the
        # deployment set is the bounded side, so it is broadcast when small.
        return pods.join(F.broadcast(deployments.select("deployment")), F.col("name").contains(F.col("deployment")), "inner")
    cut = F.filter(
        F.transform(
            F.sequence(F.lit(5), F.length("name")),
            lambda i: F.when(F.substring("name", i, 1) == "-", F.substring("name", 5, i - 5)),
        ),
        lambda x: x.isNotNull() & (F.length(x) > 0),
    )
    cand = pods.where(F.col("name").startswith("inf-")).select("*", F.explode(cut).alias("deployment"))
    return cand.join(deployments.select("deployment").distinct(), "deployment", "inner")


def tail(logs: DataFrame, source_col: str, seq_col: str, n: int = 5) -> DataFrame:
    """Last n lines per source. A top-n per group: ``max_by(n)``-style
    partial aggregation would need an ordered buffer, so this uses a window
    limited to n (Spark plans a WindowGroupLimit that keeps at most n rows
    per group on the map side before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(source_col).orderBy(F.col(seq_col).desc())
    return logs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
