"""Catalog scalar rules as native Column expressions (SURVEY H23-H29,
H31-H35, H40, H51, H52, B11, B14-B16, D12, F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalcat.functions.scoring import num_text


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_parse_int(text) -> Column:
    """``parseInt(x, 10)``: leading (signed) digits after optional whitespace,
    null when there are none (JS NaN)."""
    return F.regexp_extract(_c(text), r"^\s*([+-]?\d+)", 1).try_cast("long")


def js_number(text) -> Column:
    """``Number(x) || 0`` for one dotted version part: blank is 0, non-numeric 0."""
    return F.coalesce(F.trim(_c(text)).try_cast("double"), F.lit(0.0))


def parse_artifact(name) -> Column:
    """struct(ss, bs) from ``ss(\\d+)`` and ``bs(\\d+)``; null when either
    is missing."""
    ss = F.regexp_extract(_c(name), r"ss(\d+)", 1)
    bs = F.regexp_extract(_c(name), r"bs(\d+)", 1)
    return F.when(
        (ss != "") & (bs != ""),
        F.struct(ss.cast("long").alias("ss"), bs.cast("long").alias("bs")),
    )


def size_text(n) -> Column:
    """Sizes below 1024 as is, else n/1024 followed by ``k`` (may be
    fractional, e.g. 1.5k)."""
    v = _c(n).cast("double")
    return F.when(v < 1024, num_text(v)).otherwise(F.concat(num_text(v / 1024), F.lit("k")))


def size_num(text) -> Column:
    """``4k`` -> 4096, ``512`` -> 512 (null when not numeric)."""
    t = _c(text)
    return F.when(
        t.endswith("k"), F.substring(t, 1, F.length(t) - 1).try_cast("double") * 1024
    ).otherwise(t.try_cast("double"))


def latest_version(keys) -> Column:
    """Highest integer-parsable version key as text; "1" when there are
    no keys or none parses."""
    nums = F.filter(F.transform(_c(keys), lambda k: js_parse_int(k)), lambda v: v.isNotNull())
    return F.coalesce(F.array_max(nums).cast("string"), F.lit("1"))


# Fixed value: dynamic sequence sizes below this are never offered.
MIN_DYNAMIC_SIZE = 32768


def halving_sizes(lo, hi, step) -> Column:
    """Hi, hi/2, hi/4, ... while >= lo, keeping members of
    range(lo, hi, step) (inclusive of hi), then only sizes >= 32768."""
    lo, hi, step = _c(lo).cast("long"), _c(hi).cast("long"), _c(step).cast("long")
    seq = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftright", hi, i))
    return F.filter(
        seq,
        lambda v: (v >= lo)
        & (v <= hi)
        & (v > 0)
        & (((v - lo) % step) == 0)
        & (v >= MIN_DYNAMIC_SIZE),
    )


def version_key(text) -> Column:
    """A key of a dotted version, of any number of parts, that orders like
    the part-wise compare of numbers in which missing and non-numeric parts
    are 0. Parts that aren't 0 become entries (sign, zeros before it, part),
    with the zeros counted against the sign, since a run of zeros puts off
    what follows; the end is an entry between the signs."""
    parts = F.transform(F.split(_c(text), r"\."), lambda p: js_number(p))
    entry = lambda sign, zeros, part: F.struct(sign.cast("int").alias("sign"), zeros.cast("int").alias("zeros"), part.cast("double").alias("part"))
    none = F.array().cast("array<struct<sign:int,zeros:int,part:double>>")
    start = F.struct(F.lit(0).alias("zeros"), none.alias("entries"))

    def step(state, part):
        zeros = state["zeros"]
        more = F.concat(state["entries"], F.array(F.when(part < 0, entry(F.lit(-1), zeros, part)).otherwise(entry(F.lit(1), -zeros, part))))
        return F.when(part == 0, F.struct((zeros + 1).alias("zeros"), state["entries"].alias("entries"))).otherwise(F.struct(F.lit(0).alias("zeros"), more.alias("entries")))

    entries = F.aggregate(parts, start, step, lambda state: state["entries"])
    return F.concat(entries, F.array(entry(F.lit(0), F.lit(0), F.lit(0))))


def chart_version(chart, prefix: str) -> Column:
    """struct(version, has_suffix) of a chart name: the first occurrence
    of ``prefix`` is removed, then the leading x.y.z is the version (the whole
    rest when there is none); has_suffix when anything follows it."""
    c = _c(chart)
    at = F.instr(c, prefix)
    full = F.when(
        at > 0,
        F.concat(F.substring(c, 1, at - 1), F.substring(c, at + len(prefix), 1 << 30)),
    ).otherwise(c)
    ver = F.regexp_extract(full, r"^(\d+\.\d+\.\d+)", 1)
    v = F.when(ver != "", ver).otherwise(full)
    return F.struct(v.alias("version"), (full != v).alias("has_suffix"))


def strip_bucket(path) -> Column:
    """Drop a ``gs://bucket/`` prefix and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"^gs://[^/]+/", ""), r"/$", "")


def normalize_root(path) -> Column:
    """Storage root -> struct(value, stripped, valid, warning). Object
    store roots collapse to the bucket root (flag + warning when a sub-path
    was dropped); other roots get one trailing slash; blank is invalid."""
    orig = F.trim(F.coalesce(_c(path), F.lit("")))
    is_bucket = orig.rlike(r"(?i)^gs://[^/]+")
    bucket = F.regexp_extract(orig, r"(?i)^gs://([^/]+)", 1)
    head = F.regexp_extract(orig, r"(?i)^(gs://[^/]+/?)", 1)
    rest = F.regexp_replace(F.substring(orig, F.length(head) + 1, 1 << 30), r"/+$", "")
    root = F.concat(F.lit("gs://"), bucket, F.lit("/"))
    stripped = is_bucket & (F.length(rest) > 0)
    warning = F.when(
        stripped,
        F.format_string(
            'checkpointsDir "%s" includes a path below the GCS bucket root. For GCS, checkpoint '
            "sub-paths are derived automatically per model, so checkpointsDir must be only the bucket "
            'root — it has been corrected to "%s". Set checkpointsDir to "gs://<your-bucket>/" to avoid this warning.',
            orig,
            root,
        ),
    )
    value = (
        F.when(orig == "", F.lit(""))
        .when(is_bucket, root)
        .when(orig.endswith("/"), orig)
        .otherwise(F.concat(orig, F.lit("/")))
    )
    return F.struct(
        value.alias("value"),
        F.coalesce(stripped, F.lit(False)).alias("stripped"),
        (orig != "").alias("valid"),
        warning.alias("warning"),
    )


def _key_base(model) -> Column:
    s = F.regexp_replace(F.upper(_c(model)), "[^A-Z0-9]", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, "^_|_$", "")


def checkpoint_key(model) -> Column:
    """``Meta-Llama-3.3-70B`` -> ``META_LLAMA_3_3_70B_CKPT``."""
    return F.concat(_key_base(model), F.lit("_CKPT"))


def vision_key(model) -> Column:
    """Vision checkpoint key; a trailing ``_INSTRUCT`` is dropped."""
    return F.concat(F.regexp_replace(_key_base(model), "_INSTRUCT$", ""), F.lit("_VISION_EMBD_CKPT"))


def deployment_name(bundle) -> Column:
    """``b-x`` -> ``bd-x``; any other name gets a ``bd-`` prefix."""
    b = _c(bundle)
    return F.when(b.startswith("b-"), F.concat(F.lit("bd-"), F.substring(b, 3, 1 << 30))).otherwise(
        F.concat(F.lit("bd-"), b)
    )


def parse_ref(text) -> Column:
    """``name:version`` -> struct(name, version, valid)."""
    t = _c(text)
    ok = t.rlike(r"^(.+):(\d+)$")
    return F.struct(
        F.when(ok, F.regexp_extract(t, r"^(.+):(\d+)$", 1)).alias("name"),
        F.when(ok, F.regexp_extract(t, r"^(.+):(\d+)$", 2)).alias("version"),
        F.coalesce(ok, F.lit(False)).alias("valid"),
    )


def pick_draft(config_draft, group_draft, model_draft) -> Column:
    """Per-config draft, else the group default, else the model default
    (blank values do not count)."""
    def nz(x):
        return F.nullif(F.trim(_c(x)), F.lit(""))

    return F.coalesce(nz(config_draft), nz(group_draft), nz(model_draft))


def first_entry_key(m) -> Column:
    """First key of a map in its key order (null for an empty map)."""
    return F.get(F.map_keys(_c(m)), 0)


def vector_preview(v, n: int = 8) -> Column:
    """``[dim]`` label and the first n elements to 4 decimals."""
    arr = _c(v)
    return F.struct(
        F.concat(F.lit("["), F.size(arr).cast("string"), F.lit("]")).alias("size_label"),
        F.array_join(F.transform(F.slice(arr, 1, n), lambda x: F.format_string("%.4f", x)), ", ").alias("preview"),
    )


def is_dynamic(artifact) -> Column:
    """Dynamic artifacts carry ``dyt`` in the name."""
    return _c(artifact).contains("dyt")


def is_speculative(artifact) -> Column:
    """Some ``-``-separated part of the name is ``sd<digits>``."""
    return F.exists(F.split(_c(artifact), "-"), lambda p: p.rlike(r"^sd\d+$"))


def excluded_suffix(name) -> Column:
    """Names ending in -dev or -prod are dropped from catalog diffs."""
    n = _c(name)
    return n.endswith("-dev") | n.endswith("-prod")


def classify_pod(name) -> Column:
    """Pod kind by name substring."""
    n = _c(name)
    return F.when(n.contains("-cache-"), F.lit("cache")).when(
        n.contains("-q-default-n-"), F.lit("default")
    ).otherwise(F.lit("other"))


def deployment_status(cache_ready, cache_total, default_ready, default_total) -> Column:
    """No pods -> Not Deployed; both pods ready == total -> Deployed;
    otherwise Deploying. Pass nulls for a missing pod."""
    has_cache = _c(cache_total).isNotNull()
    has_default = _c(default_total).isNotNull()
    c_ok = F.coalesce(has_cache & (_c(cache_ready) == _c(cache_total)), F.lit(False))
    d_ok = F.coalesce(has_default & (_c(default_ready) == _c(default_total)), F.lit(False))
    return (
        F.when(~has_cache & ~has_default, F.lit("Not Deployed"))
        .when(c_ok & d_ok, F.lit("Deployed"))
        .otherwise(F.lit("Deploying"))
    )
