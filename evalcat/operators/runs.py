"""Run expansion, resume and run-metadata operators (SURVEY C1-C8, E1, E2,
E6, D17, G1, G5, I3 batch, I7, A13).

The task grid is the one place where the output is a product: every example
is evaluated by every configured model. Resuming a run never forms it: prior
rows are joined to the models and to the examples, and what is left to do
comes from the set of models that each example has done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcat.functions.scoring import is_finite

KEY = ["provider", "model", "example_id"]

# Models up to which their table is broadcast; longer ones are joined by shuffle.
BROADCAST_MODELS = 4096


def _models(models: DataFrame | Sequence[dict], spark) -> tuple[DataFrame, int]:
    """(model_index, provider, model), with a broadcast hint if they are few,
    and their number. A list has its own order."""
    if not isinstance(models, DataFrame):
        rows = [(i, m["provider"], m["model"]) for i, m in enumerate(models)]
        models = spark.createDataFrame(rows, "model_index long, provider string, model string")
    table = models.select(F.col("model_index").cast("long").alias("model_index"), "provider", "model")
    n = table.count()
    return F.broadcast(table) if n <= BROADCAST_MODELS else table, n


def _result_id(n: int, ordinal_col: str) -> Column:
    return (F.col("model_index") * F.lit(n) + F.col(ordinal_col) + 1).alias("result_id")


def task_grid(
    examples: DataFrame,
    models: DataFrame | Sequence[dict],
    ordinal_col: str = "ordinal",
    n_examples: int | None = None,
) -> DataFrame:
    """C1 + E1: models x examples in model-major order with
    ``result_id = model_index * n + ordinal + 1``.

    ``examples`` carries a dense 0-based ``ordinal`` (see
    ``ranking.with_row_index``); ``models`` has provider, model and a dense
    0-based ``model_index``. Each example lists the indices of the models, and
    the models are joined to these by an equi-join: any number of models."""
    table, n_models = _models(models, examples.sparkSession)
    n = n_examples if n_examples is not None else examples.count()
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_models - 1).cast("long")) if n_models else F.array().cast("array<long>"))
    return examples.select("*", each.alias("model_index")).join(table, "model_index").select(_result_id(n, ordinal_col), "model_index", "provider", "model", *examples.columns)


def _completed(prior: DataFrame) -> DataFrame:
    return prior.where(F.col("status") == "completed")


def carry_completed(prior: DataFrame, models: DataFrame | Sequence[dict], examples: DataFrame, ordinal_col: str = "ordinal", n_examples: int | None = None) -> DataFrame:
    """The ``completed`` prior rows (one a key, as the upsert sink keeps
    them) whose model and example are still asked for, with the result_id of
    their place in the grid. A model that is listed twice carries a row twice."""
    table, _ = _models(models, prior.sparkSession)
    n = n_examples if n_examples is not None else examples.count()
    kept = _completed(prior).drop("result_id").join(table, ["provider", "model"]).join(examples.select("example_id", ordinal_col), "example_id")
    return kept.select(_result_id(n, ordinal_col), "model_index", ordinal_col, *KEY, *[c for c in prior.columns if c not in ("result_id", "model_index", ordinal_col, *KEY)])


def pending_tasks(carried: DataFrame, models: DataFrame | Sequence[dict], examples: DataFrame, ordinal_col: str = "ordinal", n_examples: int | None = None) -> DataFrame:
    """What is left to do when ``carried`` (C2) is done: (result_id,
    model_index, provider, model, columns of examples). Each example has the
    set of its done models taken from all models; only the rest becomes rows."""
    table, n_models = _models(models, carried.sparkSession)
    n = n_examples if n_examples is not None else examples.count()
    done = carried.groupBy(F.col(ordinal_col).alias("_of")).agg(F.collect_set("model_index").alias("_done"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n_models - 1).cast("long")) if n_models else F.array().cast("array<long>")
    rest = F.when(F.col("_done").isNull(), every).otherwise(F.array_except(every, F.col("_done")))
    open_ = examples.join(done, F.col(ordinal_col) == F.col("_of"), "left").select(*examples.columns, F.explode(rest).alias("model_index"))
    return open_.join(table, "model_index").select(_result_id(n, ordinal_col), "model_index", "provider", "model", *examples.columns)


def prune_prior(prior: DataFrame, models: DataFrame | Sequence[dict], examples: DataFrame) -> DataFrame:
    """C4: prior rows whose model and example are still asked for."""
    table, _ = _models(models, prior.sparkSession)
    return prior.join(table.select("provider", "model"), ["provider", "model"], "left_semi").join(examples.select("example_id"), "example_id", "left_semi")


def with_provider(tasks: DataFrame, providers: DataFrame) -> DataFrame:
    """Attach the provider row; an unknown provider becomes an error
    message column instead of a dropped task."""
    p = providers.select(
        F.col("name").alias("provider"), F.col("api_url"), F.lit(True).alias("_known")
    )
    out = tasks.join(p, "provider", "left")
    return out.withColumn(
        "provider_error",
        F.when(
            F.col("_known").isNull(),
            F.format_string('Provider "%s" not found in providers.json', F.col("provider")),
        ),
    ).drop("_known")


def needed_providers(models: DataFrame, scorers: DataFrame | None = None) -> DataFrame:
    """Distinct providers referenced by models (and judge scorers)."""
    names = models.select(F.col("provider").alias("name"))
    if scorers is not None:
        names = names.unionByName(scorers.select(F.col("provider_name").alias("name")))
    return names.where(F.col("name").isNotNull()).distinct()


def missing_providers(models: DataFrame, providers: DataFrame, scorers: DataFrame | None = None) -> DataFrame:
    """Referenced providers that are not configured (sorted by name)."""
    need = needed_providers(models, scorers)
    return need.join(providers.select("name"), "name", "left_anti").orderBy("name")


def with_scorer(tasks: DataFrame, scorers: DataFrame) -> DataFrame:
    """Inline scorer definition first, else the named scorer, else an
    error text. ``tasks`` has scorer_name and an optional inline struct
    ``scorer_def``; ``scorers`` has name + definition columns."""
    s = scorers.select(
        F.col("name").alias("scorer_name"),
        F.struct(*[c for c in scorers.columns]).alias("_named"),
    )
    out = tasks.join(s, "scorer_name", "left")
    inline = F.col("scorer_def") if "scorer_def" in tasks.columns else F.lit(None)
    return out.withColumn("scorer", F.coalesce(inline, F.col("_named"))).withColumn(
        "scorer_error",
        F.when(
            F.col("scorer").isNull() & F.col("scorer_name").isNull(),
            F.lit('Experiment uses an LLM judge but neither "scorer.definition" nor "scorer.scorer_name" is set'),
        ).when(
            F.col("scorer").isNull(),
            F.format_string('Scorer "%s" not found in data/scorers/', F.col("scorer_name")),
        ),
    ).drop("_named")


def results_with_examples(results: DataFrame, examples: DataFrame) -> DataFrame:
    """Result rows next to their example (inner join on example_id)."""
    return results.join(examples, "example_id", "inner")


def merge_rows(carried: DataFrame, new: DataFrame) -> DataFrame:
    """G1: carried rows plus newly produced rows (by column name)."""
    return carried.unionByName(new, allowMissingColumns=True)


def latest_runs(runs: DataFrame, exp_col: str = "experiment_id") -> DataFrame:
    """Newest run per experiment (by started_at, run_id breaks ties).
    ``max_by`` is a partial aggregate, so an experiment with very many runs is
    pre-reduced map-side."""
    cols = [c for c in runs.columns if c != exp_col]
    latest = runs.groupBy(exp_col).agg(
        F.max_by(F.struct(*cols), F.struct("started_at", "run_id")).alias("_r")
    )
    return latest.select(exp_col, "_r.*")


def resumable_runs(runs: DataFrame, exp_col: str = "experiment_id") -> DataFrame:
    """The latest run of an experiment, when it is not completed."""
    return latest_runs(runs, exp_col).where(F.col("status") != "completed")


def upsert_latest(
    rows: DataFrame, keys: Sequence[str] = KEY, seq_col: str = "write_seq"
) -> DataFrame:
    """Last write wins per key (highest ``seq_col``). Uses ``max_by`` over
    a struct instead of a window so duplicates are reduced map-side and a key
    with many writes never needs a full sort of its group. ``order_results``
    puts the rows in the order of result_id."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq_col)).alias("_r"))
    return best.select(*keys, "_r.*")


def next_id(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Smallest positive integer not used as an id (one row)."""
    used = ids.select(F.col(id_col).cast("long").alias("v")).where(F.col("v") >= 1).distinct()
    cands = used.select((F.col("v") + 1).alias("v")).unionByName(
        used.sparkSession.range(1, 2).select(F.col("id").alias("v"))
    )
    free = cands.join(used, "v", "left_anti")
    return free.agg(F.min("v").alias("next_id"))


def reap_orphans(
    runs: DataFrame,
    now: Column,
    active: DataFrame | None = None,
    grace_seconds: float = 15.0,
    exp_col: str = "experiment_id",
) -> DataFrame:
    """I3 (batch): a ``running`` run that no live process owns and that started
    more than ``grace_seconds`` ago (or whose start is unreadable) becomes
    ``interrupted`` with ``finished_at = now``."""
    r = runs
    if active is not None:
        r = r.join(
            active.select(exp_col, "run_id").withColumn("_active", F.lit(True)),
            [exp_col, "run_id"],
            "left",
        )
    else:
        r = r.withColumn("_active", F.lit(None).cast("boolean"))
    age = now.cast("double") - F.col("started_at").cast("double")
    orphan = (
        (F.col("status") == "running")
        & F.col("_active").isNull()
        & (F.col("started_at").isNull() | ~is_finite(age) | (age >= grace_seconds))
    )
    r = r.withColumn("_orphan", orphan)
    return (
        r.withColumn("status", F.when(F.col("_orphan"), F.lit("interrupted")).otherwise(F.col("status")))
        .withColumn("finished_at", F.when(F.col("_orphan"), now).otherwise(F.col("finished_at")))
        .drop("_active", "_orphan")
    )


# Run lifecycle events and the status each one leaves behind.
RUN_EVENT_STATUS = {
    "create": "running",
    "resume": "running",
    "complete": "completed",
    "abort": "aborted",
    "interrupt": "interrupted",
}


def run_state(events: DataFrame, exp_col: str = "experiment_id") -> DataFrame:
    """Fold run lifecycle events (create, resume, complete, abort,
    interrupt) into RunMeta rows: status from the last event, started_at from
    create, resumed_at = ordered resume times, finished_at from the last
    terminal event (a resume does not clear it, as in the reference's run
    metadata). All partial aggregates."""
    status = F.create_map(*[F.lit(x) for kv in RUN_EVENT_STATUS.items() for x in kv])
    ev = events.withColumn("_status", status[F.col("event")])
    terminal = F.col("event").isin("complete", "abort", "interrupt")
    agg = ev.groupBy(exp_col, "run_id").agg(
        F.max_by("_status", F.struct("ts", "seq")).alias("status"),
        F.min(F.when(F.col("event") == "create", F.col("ts"))).alias("started_at"),
        F.array_sort(F.collect_list(F.when(F.col("event") == "resume", F.col("ts")))).alias("resumed_at"),
        F.max(F.when(terminal, F.col("ts"))).alias("finished_at"),
    )
    return agg


def recount_meta(runs: DataFrame, results: DataFrame) -> DataFrame:
    """D1 applied to metadata: completed/errors of each run from its rows."""
    keys = ["experiment_id", "run_id"]
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
    )
    return runs.drop("completed", "errors").join(counts, keys, "left").fillna(
        0, subset=["completed", "errors"]
    )


def order_results(results: DataFrame) -> DataFrame:
    """results by result_id."""
    return results.orderBy("result_id")


def runs_newest(runs: DataFrame) -> DataFrame:
    """runs newest first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def sort_by(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """sort by any column, nulls last."""
    c = F.col(col)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def window_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
