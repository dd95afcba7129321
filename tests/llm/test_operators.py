"""Small tests of the training-data operators: brute force, exact round trips
and the edge cases their docstrings name."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcat.llm import decontaminate, license_scan, lm_score, near_dup, packing, quality, queries, token_files, tokens, toxicity, vector_join, warc

BYTE, WORD = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(9000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (2, BASE, None), (3, BASE.replace("alpha59", "beta"), "b"), (4, None, "b"), (None, "", None),
    (5, LONG, "c"), (6, "one two", "c"), (7, "Don't  stop\n\n it's\tÉté <|endoftext|>!", "d"), (None, "gamma delta " * 30, "d"),
]
SCHEMA = "doc_id long, text string, rid string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long and repeated rows, and a column named like an operator's own."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chunked_encoding_equals_the_library():
    texts = ["", "  a b ", "a\tb  c", "\n\nx y\n", "don't 's it's  'll", "x\x00y z", "b ̈c", "<|endoftext|> hi", "日本 語\n語", "ΑΣ ΣΑ Σ", "\nfoo", "hi,\nthere\n\nfoo  bar\n baz", LONG]
    for path in (BYTE, WORD):
        got, want = tokens.coder(path), tokens.Whole(tokens.load(path))
        assert not isinstance(got, tokens.Whole)
        (a, n), (b, m) = got(texts), want(texts)
        assert n.tolist() == m.tolist() and a.tolist() == b.tolist()


def test_packing(docs, empty):
    pieces, places = packing.pack_documents(docs, WORD)
    whole = tokens.Whole(tokens.load(WORD))
    rows = pieces.join(places, "item_id").collect()
    want = Counter()
    for d, t, _ in ROWS:
        ids = [*whole.lists([t or ""])[0], 1]
        want.update((d, k, np.array(ids[s : s + 4096], "<u4").tobytes()) for k, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 4096
    assert len(by) == math.ceil(sum(r.length for r in rows) / 4096)
    assert sorted(r.length for r in packing.sequences(pieces, places).collect()) == sorted(sum(p[1] for p in v) for v in by.values())
    assert packing.pack_documents(empty, WORD)[1].count() == 0


def test_packing_climbs_levels(spark):
    items = spark.range(3000).select(F.col("id").alias("item_id"), (F.col("id") * 37 % 90 + 1).alias("length"))
    got = packing.pack_items(items, capacity=100, per_task=200, tolerance=0).join(items, "item_id").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    rows = got.collect()
    at_once = packing.best_fit(np.sort(np.arange(3000) * 37 % 90 + 1)[::-1], 100)[0].max() + 1
    # groups of 200 items cost up to 3 % over best fit of all at once
    assert sum(r.k for r in rows) == 3000 and max(r.n for r in rows) <= 100 and len(rows) <= 1.03 * at_once


def test_variable_length_codes():
    ranks = np.array([0, 255, 256, 65535, 65536, 16777215, 16777216, 4294967295, 7], np.uint32)
    assert token_files.decode_ranks(*token_files.encode_ranks(ranks), len(ranks)).tolist() == ranks.tolist()
    assert len(token_files.decode_ranks(*token_files.encode_ranks(ranks[:0]), 0)) == 0


def test_token_files_round_trip(spark, docs, empty):
    got = token_files.read_token_files(spark, *token_files.write_token_files(docs, BYTE, 2)).orderBy("start").collect()
    whole = tokens.Whole(tokens.load(BYTE))
    want = Counter((d, np.array([*whole.lists([t or ""])[0], 2], "<u4").tobytes()) for d, t, _ in ROWS)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:i]) for i in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert token_files.read_token_files(spark, *token_files.write_token_files(empty, BYTE, 2)).count() == 0


def test_warc_round_trip(spark):
    html = ["x" * 1000, "", None, "é\r\n\r\nWARC/1.1\r\n", "x" * 1000, "", "y" * 10, "y" * 10, "x" * 1000]
    rows = [(9 - i if i < 8 else None, None if i % 3 else f"http://h/{i}\r\nX: 1", h, i) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk_no int")
    for least in (0, 100):
        got = warc.read_archives(spark, warc.write_archives(pages, min_bytes=least, chunk_bytes=7), chunk_bytes=11).collect()
        last = {r.page_id: r for r in got if r.is_last}
        body = {}
        for r in sorted(got, key=lambda r: r.chunk_no):
            body[r.page_id] = body.get(r.page_id, b"") + bytes(r.data)
        firsts = {}
        for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            raw = (h or "").encode()
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            r, first = last[p], firsts.setdefault(digest, p)
            other = len(raw) >= least and first != p
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), digest, "revisit" if other else "response", first if other else None)
            assert body[p] == (b"" if other else raw)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    x[40:60] = x[:20] + rng.normal(size=(20, 6)).astype(np.float32) * 0.2
    x[60:75] = x[3]
    x[75:80] = x[3] * 7
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 6, 0), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (203, [float("nan")] * 6, 0), (204, [1.0], 0), (5, rows[3][1], 0)]
    got = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, root long"), block=16).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 6 and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in range(len(ids)):
        label = np.array([min(label[a], *label[near[a]]) if near[a].any() else label[a] for a in range(len(ids))])
    want = Counter(zip(ids.tolist(), near.sum(1).tolist(), label.tolist())) + Counter((i, 0, i) for i in range(200, 205))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vector_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_width_are_joined(spark):
    rows = [(i, [1.0, float(i), 0.5]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, 2.0]), (20, [3.0]), (21, [5.0]), (22, [-5.0]), (30, [1.0] * 7)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in got if i >= 10} == {10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 20: (1, 20, True), 21: (1, 20, False), 22: (0, 22, True), 30: (0, 30, True)}
    for a, v in rows[:6]:
        cos = [np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) for b, w in rows[:6] if a != b]
        assert got[a][0] == sum(c >= 0.95 for c in cos)


def _sets(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_against_brute_force(spark, docs, empty):
    words = [f"v{i}" for i in range(400)]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 80)) for _ in range(30)]
    for t in texts[:12]:
        own = t.split()
        own[int(rng.integers(80))] = "new"
        texts += [" ".join(own), " ".join(own[:50]), t.upper()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(table)[1].collect()}
    s, label = [_sets(t) for t in texts], list(range(len(texts)))
    for _ in range(3):
        for a in range(len(s)):
            for b in range(len(s)):
                if sum((s[a] & s[b]).values()) >= 0.8 * sum((s[a] | s[b]).values()):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))
    out = near_dup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [1, 4, 5, 6, 7] and out.count() == 6
    assert near_dup.deduplicated(empty).count() == 0


def test_weighted_samples_agree_as_often_as_weights_overlap():
    h = np.random.default_rng(5).integers(0, 1 << 63, 300, np.uint64)
    wa, wb = np.ones(300), np.ones(300)
    wa[:100], wb[:100], wb[100:200] = 2.0, 0.8, 3.0
    a = np.array([near_dup.sample_keys(h, wa, k).min() for k in range(56)])
    b = np.array([near_dup.sample_keys(h, wb, k).min() for k in range(56)])
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 3.5 * math.sqrt(want * (1 - want) / 56)


def test_benchmark_leaks_against_brute_force(spark, docs, empty):
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, " ".join(f"z{i}" for i in range(12))), (3, None), (None, "tiny item"), (4, " ".join(f"alpha{i}" for i in range(10, 40)))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, leaks string")
    texts = ["pre " + items[0][1].upper().replace(" ", ", ") + " post", items[0][1].replace("q19", "other"), items[1][1].replace("z6", "other"), "a tiny item b", "nothing here", None, LONG + " " + items[1][1]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = decontaminate.with_leaks(table, bench).collect()
    parts = decontaminate.with_leaks(table, bench, block_items=2).collect()
    assert [sorted(str(x) for x in r.leaks) for r in one] == [sorted(str(x) for x in r.leaks) for r in parts]
    assert {r.doc_id: sorted((x.item_id or 0) for x in r.leaks) for r in one} == {0: [1], 1: [1], 2: [], 3: [0], 4: [], 5: [], 6: [2]}
    assert one[0].leaks[0].similarity == 1.0 and one[0].leaks[0].start_word == 1
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == 6 and decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_benchmark_leaks_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(11)
    shared = [" ".join(f"s{i}x{k}" for k in range(8)) for i in range(6)]  # passages that many items hold
    items = [(i, " ".join([shared[i % 6], *(f"i{i}y{k}" for k in range(12)), shared[i * 5 % 6]])) for i in range(60)]
    texts = []
    for i, t in items * 2:
        words = t.split()
        for at in rng.choice(len(words), int(rng.integers(1, 4)), replace=False):
            words[at] = shared[int(rng.integers(6))] if rng.random() < 0.5 else "other"
        texts.append(" ".join(words))
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [{(r.doc_id, x.item_id, round(x.similarity, 9), x.start_word) for r in decontaminate.with_leaks(table, bench, threshold=0.6, block_items=n).collect() for x in r.leaks} for n in (1000, 7)]
    assert found[0] and found[0] == found[1]


def test_license_spans_against_full_alignment(spark, docs, empty):
    text = "Head. " + license_scan.TEMPLATES["MIT"].replace("free of charge", "entirely free of any charge").upper() + "\n tail Released under the MIT License. end"
    table = spark.createDataFrame([(1, text), (2, None), (None, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    got = {(r.doc_id, r.template): r for r in license_scan.scan(table).collect()}
    assert set(got) == {(1, "MIT"), (1, "MIT-line"), (None, "Apache-2.0-line")}
    r = got[1, "MIT-line"]
    assert text[r.start_char : r.end_char] == "Released under the MIT License" and r.coverage == 1.0
    from evalcat.llm.textcache import word_hashes

    t, d = word_hashes([license_scan.TEMPLATES["MIT"]])[0], word_hashes([text])[0]
    full = license_scan.aligned(t, d, -len(t), len(d))  # a band as wide as both
    r = got[1, "MIT"]
    assert (r.matched_words, r.first_word, r.last_word + 1) == full and r.coverage > 0.95
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0 and license_scan.scan(table, {}).count() == 0


def test_whole_license_texts_get_their_own_names(spark):
    names = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MIT", "LGPL-2.1", "GPL-3.0", "AGPL-3.0", "Unlicense", "CC-BY-SA-4.0"]
    texts = [f"Copyright someone {license_scan.TEMPLATES[n]} And then code." for n in names]
    cut = " ".join(license_scan.TEMPLATES["MIT"].split()).split("THE SOFTWARE IS PROVIDED")[0]
    table = spark.createDataFrame([*enumerate(texts), (90, cut), (91, license_scan.TEMPLATES["ISC"][:200])], "doc_id long, text string")
    rows = license_scan.scan(table).collect()
    # a notice within a text is reported, the text names the document
    assert {(r.doc_id, r.template) for r in rows if r.best} == set(enumerate(names))
    assert {r.coverage for r in rows if r.best} == {1.0}
    assert not [r for r in rows if r.doc_id >= 90]
    assert max(r.coverage for r in rows if r.doc_id == 0 and r.template == "BSD-3-Clause") < 0.9


def test_short_licenses_changed_or_repeated(spark):
    templates = {"line": "Released under the MIT License.", "twelve": " ".join(f"n{i}" for i in range(12)), "two": "public domain"}
    words = templates["twelve"].split()
    texts = ["we Released under an MIT License here", " ".join(templates.values()) + " " + "Released under the MIT License. " * 7]
    texts += [" ".join([*words[:a], "x", *words[a + 1 : b], "y", *words[b + 1 :]]) for a in range(11) for b in range(a + 1, 12)]
    texts += ["filler " * 500 + "it is public domain. " + templates["twelve"] + " and " + templates["twelve"]]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    # a replaced first or last word is no part of the span
    assert Counter((r.doc_id, r.template) for r in rows) == Counter({(0, "line"): 1, (1, "line"): 8, (1, "twelve"): 1, (1, "two"): 1, **{(i, "twelve"): 1 for i in range(2, 68)}, (68, "two"): 1, (68, "twelve"): 2})
    assert [r.coverage for r in rows if r.doc_id == 0] == [0.8]
    spans = sorted((r.first_word, r.last_word) for r in rows if r.doc_id == 1)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and {r.coverage for r in rows if r.doc_id in (1, 68)} == {1.0}


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_against_brute_force(spark, docs, empty, order):
    words = [re.findall(r"\w+", (t or "").lower()) for _, t, _ in ROWS]
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [count(w) for w in words]
    every = sum(own, Counter())
    total = sum(map(len, words))
    want = Counter()
    for (d, _, _), w, mine in zip(ROWS, words, own):
        c, x = lambda g, m=mine: every[g] - m[g], 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n > 1 and c(g) > 0:
                    x += math.log(c(g) / c(g[:-1]))
                    break
                x += math.log(0.4) if n > 1 else math.log(c(g) / (total - len(w)) if c(g) else 1 / (total - len(w) + 1))
        want[d, len(w), round(x, 6) if w else None] += 1
    got = lm_score.lm_scores(docs, order=order).collect()
    assert Counter((r.doc_id, r.words, None if r.log_score is None else round(r.log_score, 6)) for r in got) == want
    assert lm_score.lm_scores(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    good = [(i, " ".join(f"word{(i * k) % 50} and" for k in range(30)) + ".", 1) for i in range(200)]
    bad = [(1000 + i, "### $$$ " * (10 + i % 7), 0) for i in range(100)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = rows.select("doc_id", "quality", F.lit("x").alias("text"))
    got = quality.score(rows.withColumn("quality_score", F.lit(9)), labels).collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert out and all((r.quality_score >= 0.3) == (r.quality == 1) for r in out)
    assert quality.score(docs, labels).count() == len(ROWS) and quality.score(empty, labels).count() == 0
    assert {r.quality_score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_string_kernel_against_direct_sum():
    a, b = toxicity.letters("idiot"), toxicity.letters("idxiot")

    def features(s):
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    assert toxicity.kernel([a], [b])[0, 0] == pytest.approx(dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)))


def test_toxicity_finds_gapped_insults(spark, docs, empty):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeionrtsdlmu"), 6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" blockhead" if i % 4 == 0 else "") + ".", int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(table, table).collect()
    assert all((r.toxicity_score >= 0.7) == (r.toxic == 1) for r in got)
    more = spark.createDataFrame([(1, "you b l o c k h e a d"), (2, "b.l.o.c.k.h.e.a.d!"), (3, "blockxhead"), (4, words[0])], "doc_id long, text string")
    model = toxicity.fit(table, table)
    assert model is not None
    scores = [max(v[0] for v in toxicity.run_scores(model[0], toxicity.runs_of(r.text))) for r in more.collect()]
    assert min(scores[:3]) > scores[3]
    assert toxicity.score(docs, table.limit(0)).count() == len(ROWS) and toxicity.score(empty, table).count() == 0


def test_kernel_tells_words_of_other_scripts_apart():
    words = ["идиот", "привет", "ідіот", "ηλίθιος", "βλάκας", "καλημέρα", "طماطم", "مرحبا", "バカヤロウ", "コンニチハ", "ありがとう"]
    codes = [toxicity.letters(w) for w in words]
    like = toxicity.kernel(codes, codes) - np.eye(len(words))
    assert like[0, 2] > 0.05 and max(like[i, j] for i in range(len(words)) for j in range(i) if (i, j) != (2, 0)) < 0.05
    assert all(len(set(toxicity.letters(a))) == len(a) for a in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρσςτυφχψω"))


def test_scoring_sees_the_runs_of_training():
    from evalcat.llm.textcache import SPACE, Buffer, char_classes

    blanks = [i for i in range(0x110000) if char_classes()[i] & SPACE]
    assert all(toxicity._BLANKS.fullmatch(chr(i)) for i in blanks) and len(toxicity._BLANKS.findall("x".join(map(chr, range(0xD800))))) == sum(i < 0xD800 for i in blanks)
    for text in ["you moron\r\nNext one\r\n", "a\tmoron\tb", "a\u00a0moron\u2003b c\x00d", " \t x\n\ty"]:
        b = Buffer([text])
        begins, ends, _ = b.blank_chunks()
        cut = [text[s:e] for s, e in zip(begins, ends)]
        assert "".join(cut) == text and [r for c in cut for r in toxicity.runs_of(c)] == toxicity.runs_of(text)
        assert all(len(toxicity.runs_of(c)) <= 1 for c in cut)


def test_pipeline_stages_chain(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        now = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).select("doc_id").distinct().count() <= now.count()
