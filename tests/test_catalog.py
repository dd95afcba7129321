
from evalcat.functions import catalog as K
from evalcat.operators import catalog as C

INV = (
    "artifact string, version_keys array<string>, task_name string, bs_values array<long>, batch_size long, "
    "seq_min long, seq_max long, seq_step long"
)


def test_static_parse_and_latest_version(spark):
    inv = spark.createDataFrame(
        [
            ("llama-3p1-70b-ss4096-bs1-sd9", ["1", "2", "3"], None, None, None, None, None, None),
            ("model-ss512-bs8", ["5", "10"], None, None, None, None, None, None),
            ("model-ss1024-bs1", None, None, None, None, None, None, None),
            ("no-sizes-here", ["1"], None, None, None, None, None, None),
        ],
        INV,
    )
    got = {r.artifact: (r.ss, r.bs, r.version) for r in C.expand_configs(inv).collect()}
    assert got == {
        "llama-3p1-70b-ss4096-bs1-sd9": ("4k", "1", "3"),
        "model-ss512-bs8": ("512", "8", "10"),
        "model-ss1024-bs1": ("1k", "1", "1"),
    }


def test_dynamic_expansion(spark):
    inv = spark.createDataFrame(
        [
            ("m-dyt-a", ["2"], None, [2, 4, 6, 8], None, 8192, 131072, 4096),
            ("m-dyt-b", ["1"], None, [1], None, None, 65536, None),
            ("m-dyt-c", ["1"], None, [1], None, 4096, 16384, 4096),
            ("m-dyt-d", ["1"], None, None, 4, None, 32768, None),
        ],
        INV,
    )
    cfg = C.expand_configs(inv).collect()
    a = [(r.ss, r.bs) for r in sorted((r for r in cfg if r.artifact == "m-dyt-a"), key=lambda r: r.entry_pos)]
    assert a == [(s, b) for s in ("128k", "64k", "32k") for b in ("2", "4", "6", "8")]
    assert [(r.ss, r.bs, r.is_dynamic) for r in cfg if r.artifact == "m-dyt-b"] == [("64k", "1", True)]
    assert [r for r in cfg if r.artifact == "m-dyt-c"] == []
    assert [(r.ss, r.bs, r.is_dynamic) for r in cfg if r.artifact == "m-dyt-d"] == [("32k", "4", False)]


def test_precedence_and_availability(spark):
    mapping = spark.createDataFrame(
        [("A", 0, "a-ss4096-bs1"), ("A", 1, "a-dyt"), ("B", 0, "a-ss4096-bs1"), ("B", 1, "b-ss8192-bs2"),
         ("E", 0, "e-ss4096-bs1"), ("F", 0, "f-ss4096-bs1")],
        "model string, pos int, artifact string",
    )
    cfg = spark.createDataFrame(
        [("a-ss4096-bs1", False, 0, "4k", "1", "1"), ("a-dyt", True, 0, "32k", "1", "1"), ("b-ss8192-bs2", False, 0, "8k", "2", "1"),
         ("e-ss4096-bs1", False, 0, "4k", "1", "1")],
        "artifact string, is_dynamic boolean, entry_pos int, ss string, bs string, version string",
    )
    kept = {r.artifact for r in C.apply_precedence(cfg, mapping).collect()}
    assert kept == {"a-dyt", "b-ss8192-bs2", "e-ss4096-bs1"}  # the shared static artifact is gone for B too
    ck = spark.createDataFrame(
        [("A", "p/a"), ("B", "p/b"), ("E", ""), ("F", "p/f"), ("G", "p/g")], "model string, path string"
    )
    avail = [r.model for r in C.available_models(ck, mapping, C.apply_precedence(cfg, mapping)).collect()]
    assert avail == ["A", "B"]  # E: empty path; F: no config; G: no artifacts


def test_key_names_and_roots(spark):
    df = spark.createDataFrame([("Meta-Llama-3.3-70B-Instruct",), ("--a..b--",), ("Qwen2.5-VL-7B",)], "m string")
    got = [(r[0], r[1]) for r in df.select(K.checkpoint_key("m"), K.vision_key("m")).collect()]
    assert got == [
        ("META_LLAMA_3_3_70B_INSTRUCT_CKPT", "META_LLAMA_3_3_70B_VISION_EMBD_CKPT"),
        ("A_B_CKPT", "A_B_VISION_EMBD_CKPT"),
        ("QWEN2_5_VL_7B_CKPT", "QWEN2_5_VL_7B_VISION_EMBD_CKPT"),
    ]
    roots = spark.createDataFrame([("",), ("gs://bucket/",), ("gs://bucket/deep/path/",), ("/mnt/nfs",), ("s3://x/y",)], "p string")
    got = [(r.n.value, r.n.stripped, r.n.valid, r.n.warning is not None) for r in roots.select(K.normalize_root("p").alias("n")).collect()]
    assert got == [
        ("", False, False, False),
        ("gs://bucket/", False, True, False),
        ("gs://bucket/", True, True, True),
        ("/mnt/nfs/", False, True, False),
        ("s3://x/y/", False, True, False),
    ]


def test_deployment_status_truth_table(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (0, 1, 1, 1), (1, 1, 0, 1), (1, 1, 2, 2), (1, 1, None, None)],
        "cr int, ct int, dr int, dt int",
    )
    got = [r[0] for r in df.select(K.deployment_status("cr", "ct", "dr", "dt")).collect()]
    assert got == ["Not Deployed", "Deploying", "Deploying", "Deployed", "Deploying"]


def test_draft_placement_and_embedding_default(spark):
    sel = spark.createDataFrame(
        [("T", "4k", "1", True), ("T", "4k", "2", True), ("T", "8k", "1", True), ("T", "8k", "2", False)],
        "model string, ss string, bs string, has_draft boolean",
    )
    drafts = spark.createDataFrame([("T", "D")], "model string, draft_model string")
    got = {r.ss: r.placement for r in C.draft_placement(sel, drafts).collect()}
    assert got == {"4k": "group_default", "8k": "per_config"}
    groups = spark.createDataFrame([("emb", "4k"), ("emb", "8k"), ("txt", "4k"), ("txt", "8k")], "model string, ss string")
    ck = spark.createDataFrame([("emb", "embedding"), ("txt", None)], "model string, model_type string")
    got = sorted((r.model, r.ss) for r in C.rename_min_key(groups, ck).collect())
    assert got == [("emb", "8k"), ("emb", "default"), ("txt", "4k"), ("txt", "8k")]


def test_versions_and_refs(spark):
    texts = ["1.2", "1.10", "1.2.0", "x", "", "0.0.-1", "-1", "1.2.0.0.0.0.0.0.0.3", "1.2.0.0.0.0.0.0.0.-3", "1.2.-1", "1.2.0.1", "2", "1.2.0.0.0.0.0.0.0.0.0.1", "1..3"]
    got = {r.v: r.k for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", K.version_key("v").alias("k")).collect()}

    def number(p):
        try:
            return float(p)
        except ValueError:
            return 0.0

    def compared(a, b):
        x, y = ([number(p) for p in t.split(".")] for t in (a, b))
        n = max(len(x), len(y))
        x, y = (z + [0.0] * (n - len(z)) for z in (x, y))
        return (x > y) - (x < y)

    assert all((got[a] > got[b]) - (got[a] < got[b]) == compared(a, b) for a in texts for b in texts)
    refs = spark.createDataFrame([("a:3",), ("bad",)], "r string")
    assert [(r.p.name, r.p.version, r.p.valid) for r in refs.select(K.parse_ref("r").alias("p")).collect()] == [
        ("a", "3", True), (None, None, False)
    ]
    mf = spark.createDataFrame([("m", "x", 0), ("m", "y", 1), ("m", "y", 2), ("m", "x", 3)], "model string, v string, pos int")
    assert C.mode_first(mf, ["model"], "v", "pos").first().v == "x"  # tie 2-2, x seen first
