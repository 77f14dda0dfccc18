"""Repeat removal, near-dedup of texts and vectors, the quality model and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from loomgraph.llm import components, near_dedup, quality_model, suffix_dedup, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    random.seed(4)
    words = ["".join(random.choices("abcdefghiß", k=random.randint(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(random.choices(words, k=n))
    passage, base = make(30), make(120).split()
    out = [None, "", " ", "one", "ONE", "two words", "Two Words", "a" * 300, "a" * 300, "ab" * 200, make(3000)]
    out += [make(40) + passage + make(20), passage, make(5) + passage[:-7], passage[3:] + make(9), "é" * 60, "xé" * 40]
    for _ in range(60):
        copy = list(base)
        for _ in range(random.randint(0, 12)):
            copy[random.randrange(len(copy))] = random.choice(words)
        out.append(" ".join(copy))
    out += [" ".join(base)] * 25 + [" ".join(base).upper()]
    out += [make(random.randint(1, 60)) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3, "x") for i, t in enumerate(texts())]
    random.seed(8)
    random.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, component long, rep string").repartition(5)


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingle_sets(rows, size):
    out = []
    for t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(size, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    rows = texts()
    sets = shingle_sets(rows, size)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(len(rows), links)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size).collect()}
    assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.keep_one(docs.filter("doc_id < 9"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 7]


def crowd_texts(n, pairs, seed=3):
    """n texts at 0.78 by a shared template, with `pairs` planted pairs at 0.807."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    template = [word() for _ in range(159)]
    out = [template + [word() for _ in range(22)] for _ in range(n)]
    for k in range(pairs):
        out[2 * k + 1][159:162] = out[2 * k][159:162]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def test_near_duplicates_in_a_region_crowded_by_texts_that_do_not_link(spark):
    rows = crowd_texts(1200, 60)
    sets = shingle_sets(rows, 4)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) == 60
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4).collect()}
    assert [got[i] for i in range(len(rows))] == union_find(len(rows), links)


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(21)
    make = lambda: [str(rng.randrange(10**6)) for _ in range(60)]
    a, b, c = make(), make(), make()
    near = lambda x, k: " ".join(x[:k] + ["other"] + x[k + 1 :])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a, 3)), (3, near(b, 5)), (4, " ".join(c)), (None, near(c, 0)), (None, near(c, 59)), (None, "alone and without a name")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 4, False), (0, 4, False), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


@pytest.mark.parametrize("paired", [32, 2])
def test_a_text_meets_others_of_wide_regions_by_rare_shingles(spark, monkeypatch, paired):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "WIDE", 16)
    rows = crowd_texts(90, 20, 5) + crowd_texts(60, 0, 6)
    rows += [rows[0].replace(rows[0].split()[0], "x", 1), rows[-1]]
    sets = shingle_sets(rows, 4)
    links = [(j, i) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    texts = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    at = spark.createDataFrame([(7, i, i, 1) for i in range(len(rows))], "region long, id long, component long, crowd long")
    torn = spark.createDataFrame([], "region long")
    pairs, blocks = near_dedup.meet_wide(at, 3, torn, texts, 4, 80)
    got = {tuple(r) for r in near_dedup.verify(pairs, texts, 4, 80).collect()} | {(min(r), max(r)) for r in blocks.collect()}
    assert got == set(links) and pairs.count() < 1000
    narrow = spark.createDataFrame([(i // 2, i, i, 1) for i in range(len(rows))], "region long, id long, component long, crowd long")
    assert near_dedup.meet_wide(narrow, 3, torn, texts, 4, 80)[0].isEmpty()
    assert not near_dedup.meet_wide(narrow, 3, narrow.select("region").distinct(), texts, 4, 80)[0].isEmpty()


def test_crowded_components_are_demanded_across_tasks(spark):
    rows = [(7, k, k, 10, 0, 17) for k in range(17)] + [(7, 100 + k, 100 + k, 10, 100 + k, 1) for k in range(400)] + [(8, 0, 600, 10, 600, 1)]
    at = spark.createDataFrame(rows, "region long, tail long, id long, n long, component long, crowd long").repartition(4)
    assert {tuple(r) for r in near_dedup.demanded(at).collect()} == {(100 + k, 0, 17) for k in range(400)}


def removed(rows, length):
    first = {}
    data = [(t or "").encode() for t in rows]
    for i, b in enumerate(data):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "gram"), [(50, 16), (20, 7), (9, 4)])
def test_repeats(docs, length, gram, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    monkeypatch.setattr(suffix_dedup, "SCAN", 700)
    want = removed(texts(), length)
    got = {r.doc_id: r for r in suffix_dedup.repeats(docs, length, gram).collect()}
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w[:4], i


def test_repeats_with_small_buckets(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 500)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 2000)
    want = removed(texts(), 50)
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.digest(docs).collect()} == {i: w[3] for i, w in enumerate(want)}


@pytest.mark.parametrize(("seed_bits", "mark_bits", "hot"), [(6, 64, 5000), (32, 5, 5000), (5, 4, 3), (32, 64, 1)])
def test_repeats_where_hashes_are_shared_and_seeds_are_split(docs, monkeypatch, seed_bits, mark_bits, hot):
    class Short(suffix_dedup.Stretches):
        def __init__(self, *args):
            super().__init__(*args)
            self.seed = self.seed & np.uint32((1 << seed_bits) - 1)
            self.mark = self.mark & np.uint64((1 << mark_bits) - 1)

    monkeypatch.setattr(suffix_dedup, "Stretches", Short)
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 20)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 2000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = removed(texts(), 50)
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.digest(docs).collect()} == {i: w[3] for i, w in enumerate(want)}


def test_repeats_of_a_table_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 5_000)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 50_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 19)
    monkeypatch.setattr(suffix_dedup, "HOT", 40)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    want = removed([r.text for r in rows], 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(docs.repartition(6)).collect()}
    assert got == {r.doc_id: w[:4] for r, w in zip(rows, want, strict=True)}


def test_stretches_hold_each_window_once(monkeypatch):
    random.seed(12)
    sizes = [0, 49, 50, 51, 400, 3000, 90, 1200]
    data = np.array(random.choices(b"abcd", k=sum(sizes)), np.uint8)
    offsets = np.cumsum([0, *sizes])
    want = [a + i for a, n in zip(offsets, sizes) for i in range(n - 49)]
    for scan in (300, 1000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "SCAN", scan)
        s = suffix_dedup.Stretches(offsets, data, 50, 16)
        assert sorted(a + i for a, n in zip(s.start, s.n) for i in range(n)) == want
        assert all(s.start[k] + s.n[k] - 1 <= s.place[k] <= s.start[k] + 34 for k in range(len(s.n)))
        i = np.arange(len(s.n))
        which, at, n, _ = suffix_dedup._halves(s, i)
        assert sorted(s.start[k] + a + j for k, a, m in zip(which, at, n) for j in range(m)) == want


def test_texts_without_repeats(docs):
    out = suffix_dedup.without_repeats(docs)
    want = removed(texts(), 50)
    assert out.columns == docs.columns
    rows = texts()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: None if rows[i] is None else w[4].decode("utf-8", "ignore") for i, w in enumerate(want)}
    assert suffix_dedup.digest(docs.limit(0)).count() == 0


def test_suffix_buckets_are_equal_strings():
    random.seed(9)
    strings = ["".join(random.choices("ab", k=random.randint(1, 90))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    left = np.concatenate([np.arange(len(s), 0, -1) for s in strings])
    for length in (3, 8, 9, 20, 50):
        places, bucket = suffix_dedup.refined(data, left, length)
        assert places.tolist() == np.flatnonzero(left >= length).tolist()
        own = {}
        for p, b in zip(places.tolist(), bucket.tolist(), strict=True):
            assert own.setdefault(b, data[p : p + length].tobytes()) == data[p : p + length].tobytes()
        assert len(set(own.values())) == len(own)


def test_components(spark):
    random.seed(6)
    links = [(i, i + 1) for i in range(40)] + [(100 + random.randrange(50), 100 + random.randrange(50)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(200, links)
    assert got == {x: want[x] for x in {y for a, b in links if a != b for y in (a, b)}}


def vectors():
    rng = np.random.default_rng(5)
    out = [(0, None, 1), (1, [0.0] * 8, 1), (2, [float("nan")] + [1.0] * 7, 1), (3, [None] + [1.0] * 7, 1), (4, [1.0] * 8, None), (5, [], 1), (6, [float("inf")] + [1.0] * 7, 1), (7, [3.0, 4.0], 1), (8, [3.0, 4.0], 1), (9, [6.0, 8.0], 1), (10, [3.0, 4.0], 2)]
    center = rng.standard_normal((3, 8))
    for k in range(300):
        x = center[k % 3] + rng.standard_normal(8) * (0.05 if k % 2 else 0.2)
        out.append((11 + k, x.astype(np.float32).tolist(), k % 2))
    out += [(400 + k, rng.standard_normal(8).tolist(), k % 3) for k in range(300)]
    out += [(800 + k, out[20][1], out[20][2]) for k in range(40)]
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    links, n = [], {r[0]: 0 for r in rows}
    good = [(i, np.array(x) / np.linalg.norm(x), lab) for i, x, lab in rows if x and lab is not None and None not in x and np.isfinite(x).all() and any(x)]
    for k, (i, x, lab) in enumerate(good):
        for j, y, other in good[:k]:
            if lab == other and len(x) == len(y) and x @ y >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    want = union_find(1000, links)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert got.keys() == n.keys()
    assert {i: r.component_id for i, r in got.items()} == {i: want[i] for i in n}
    assert {i: r.n_links for i, r in got.items()} == n
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_by_blocks_where_the_search_fails(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    chain = [[float(np.cos(k / 9)), float(np.sin(k / 9)), 0.0] for k in range(50)]  # each links with the next only
    crowd = [(np.array([0.0, 0.0, 1.0]) + rng.standard_normal(3) * 0.03).tolist() for _ in range(60)]
    rows = [(1000 - i, x, "a" if i % 7 else "b") for i, x in enumerate([*chain, *crowd, *rng.standard_normal((200, 3)).tolist()])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows}
    links = [(i, j) for i, _, a in rows for j, _, b in rows if a == b and i < j and unit[i] @ unit[j] >= 0.98]
    want = union_find(1001, links)
    classes = spark.createDataFrame([(i, lab, 1, unit[i].tobytes()) for i, _, lab in rows], "rep long, space string, copies long, unit binary")
    none = spark.createDataFrame([], "node long, component long")
    labels = components.components(vector_dedup.compared(classes, none, 0.98))
    got = {r.node: r.component for r in labels.collect()}
    assert {i: got.get(i, i) for i in unit} == {i: want[i] for i in unit}
    n = {r.rep: r.n for r in vector_dedup.counted(classes, labels, 0.98).collect()}
    assert {i: n.get(i, 0) for i in unit} == {i: sum(i in x for x in links) for i in unit}
    assert vector_dedup.audit(classes, labels, 0.98) == 1.0
    assert vector_dedup.audit(classes, none, 0.98) == 0.0


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_duplicates(none).count() == 0


def test_quality_model_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_model.train(docs, labels)
    assert 0 < len(model.rules) < 200
    out = quality_model.score(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.98
    assert out[out.quality == 0].predicted.mean() < 0.05
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality_model.score(odd, model).collect())


def test_quality_model_is_its_rules(spark, docs):
    x = {"words": np.array([1.0, 2.0, 3.0, 4.0] * 40), "symbols": np.array([0.0, 1.0] * 80)}
    y = (x["words"] > 2).astype(float)
    model = quality_model.fit(x, y)
    z = model.offset + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["words"], x["symbols"])], "s_words double, s_symbols double")
    assert np.allclose([r.score for r in df.select(model.column().alias("score")).collect()], 1 / (1 + np.exp(-z)))
    assert ((z > 0) == (y > 0)).all()
    assert quality_model.fit(x, np.zeros(160)).rules == []
    empty = docs.limit(0)
    assert quality_model.score(docs, quality_model.train(docs, empty.selectExpr("doc_id", "1 as quality"))).count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline
    from loomgraph.llm import packing, quality_rules, secret_scan

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs)).filter("kept").collect()}
    ids = sorted(good)
    sets = shingle_sets([rows[i] for i in ids], 5)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    ids = [ids[i] for i, c in enumerate(union_find(len(ids), links)) if i == c]
    cut = [w[4].decode("utf-8", "ignore") for w in removed([rows[i] for i in ids], 50)]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns, name
        at = at.cache()
    got = {r.doc_id: r for r in at.collect()}
    assert sorted(got) == ids
    for i, text in zip(ids, cut, strict=True):
        spans = [m for r in secret_scan.RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        assert (got[i].text == text) == (not spans)
        assert got[i].n_chars == len(got[i].text)
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == set(ids)
    assert len(out) == packing.pack(at).count()


def test_few_rows_are_staged_in_few_files(spark, docs, monkeypatch):
    """Each file costs processes; partitions that a session asks for don't become files of a few rows. The orders' neighbours keep theirs, whose numbers name seams."""
    from loomgraph.llm import common

    files = []
    made = common.staged_as

    def seen(df, name, lasting=False):
        out = made(df, name, lasting)
        files.append((name, len(out[0].inputFiles())))
        return out

    monkeypatch.setattr(common, "staged_as", seen)
    monkeypatch.setattr(components, "staged_as", seen)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = near_dedup.near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = 4 * spark.sparkContext.defaultParallelism
    assert [x for x in files if x[0] != "candidates" and x[1] > most] == []
    assert {n for k, n in files if k in ("labels", "edges", "pairs", "own", "named") and n > spark.sparkContext.defaultParallelism} == set()
    assert sorted(map(tuple, got)) == sorted(map(tuple, near_dedup.near_duplicates(docs, 4).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_a_worker_forgets_the_words_of_an_operator_before(monkeypatch):
    from loomgraph.llm import tokens

    class Kept:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(near_dedup, "_keyed", lambda docs: Kept())
    tokens.loaded(("words of another operator",), dict)
    assert list(near_dedup.signatures(None, 4)(iter(()))) == []
    assert ("words of another operator",) not in tokens._loaded
