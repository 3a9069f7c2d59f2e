"""Operators on whole tables: mixing, packing, token files, joins, embeddings, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import embeddings, mixing, ngram_join, packing, token_files
from weftline.llm.common import shared_folder
from weftline.llm.graph import components
from weftline.llm.tokens import Encoder

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key double, size long, plan string"


def docs_of(spark, data):
    return spark.createDataFrame([(i, t, "en", s, None, "e", 0.5, 9, "p") for i, t, s in data], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    e, rng = Encoder(public.path(name)), random.Random(3)
    bits = ["a", "b'S", "'s", "  ", "\n", "\n\n", " ", "é", "é", "1", "12", "\t", "\xa0", "!!", "don't", "'", "\r\n", " \n", "日本", "İ", "ß", "Σ", "\x1c", "<|endoftext|>", "x,", "y."]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_are_one_id_as_in_the_untouched_library(name):
    from tokenizers import Tokenizer

    e, plain, rng = Encoder(public.path(name)), Tokenizer.from_file(public.path(name)), random.Random(5)
    special = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert special and all(len(e.ids(t)) == 1 for t in special)
    bits = [*special, *map(str.upper, special), "<|", "|>", "a", " ", "don't", "\n", "é", "x,", "B."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        assert e.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 500, "c": 300, None: 90, "d": 0}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2), strict=True))
    target, open_ = {}, dict(weights)
    while True:  # plain water filling
        left = sum(sizes.values()) - sum(target.values())
        level = left / sum(open_.values()) if open_ else 0
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s] + 1e-9}
        if not full:
            target |= {s: level * w for s, w in open_.items()}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ = {s: w for s, w in open_.items() if s not in full}
    for s, t in target.items():
        assert got[s].weight == weights[s] and got[s].target == pytest.approx(t)
    assert sum(r.target for r in got.values()) == pytest.approx(900)


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    data = [(k, "w " * rng.choice((1, 3, 10, 40, 200)), rng.choice(["a", "b", "c", None])) for k in range(600)] + [(700, None, "a"), (701, "", "b"), (None, "x y", "c")]
    docs = docs_of(spark, data)
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(data) and all(r.taken <= 3 * r.size for r in report)
    by = defaultdict(int)
    for r in report:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 20 for (_, t), v in by.items())
    assert sorted(map(str, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(str, report))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect() if r.text) == Counter({r.id: r.copies for r in report if r.copies and r.size})
    assert mixing.mix(docs.limit(0)).count() == 0


def test_block_is_packed_whole():
    rng = np.random.default_rng(2)
    totals = np.r_[rng.integers(1, 3000, 900), 1024, 2048, 1, 1]
    doc, start, length, sequence, offset = packing.pack_block(totals)
    covered = defaultdict(list)
    for d, s, n in zip(doc, start, length, strict=True):
        covered[d].append((s, n))
    for d, pieces in covered.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == totals[d]
    fill = defaultdict(list)
    for s, o, n in zip(sequence, offset, length, strict=True):
        fill[s].append((o, n))
    ends = []
    for pieces in fill.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        ends.append(at)
    assert sum(e < 1024 for e in ends) <= 1 and max(ends) == 1024


def test_fit_never_overdraws():
    histogram = np.zeros(1025, int)
    histogram[[100, 200, 824, 924, 512]] = [5, 9, 7, 3, 4]
    combos = packing.combinations(np.flatnonzero(histogram), 1024)
    assert (combos.sum(1) == 1024).all()
    counts = packing.round_down(combos, packing.nnls(combos, histogram), histogram)
    used = np.bincount(combos.ravel(), np.repeat(counts, 3), 1025)[1:]
    assert (used <= histogram[1:]).all() and used[512 - 1] == 4


def test_pack_and_token_files(spark):
    rng = random.Random(6)
    data = [(k, " ".join(rng.choice(["alpha", "Beta,", "ça", "x1"]) for _ in range(rng.randint(0, 700))), "s") for k in range(50)] + [(60, None, None), (61, "", "s")]
    docs = docs_of(spark, data)
    path = public.path("byte_bpe_50k.json")
    want = {i: [*Encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in data}
    parts = defaultdict(dict)
    for r in packing.pack(docs, path).collect():
        assert r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {i: sum((p[s] for s in sorted(p)), []) for i, p in parts.items()} == want
    assert packing.pack(docs.limit(0), path).count() == 0
    folder, path = shared_folder(spark), public.path("word_bpe_49k.json")
    more = data + [(None, "null id first", "s"), (3, "twice", "s")]
    token_files.write_tokens(docs_of(spark, more), folder, path)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _, _ in more), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        at += r.n_tokens
    one = next(r for r in rows if r.doc_id == 7)
    assert token_files.lookup(spark, folder, [7]).first().ids == one.ids
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.digest(token_files.read_tokens(spark, folder)).collect()}
    assert crc[7, one.start] == zlib.crc32(np.array(one.ids, "<u4").tobytes())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}


def _brute_links(data, links):
    name = {i: i for i, _ in data}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for k, (i, a) in enumerate(data):
        for j, b in data[:k]:
            if links(a, b):
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in data}


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    line = " ".join(word() for _ in range(30))
    data = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((1, 3, 5, 6, 9, 40, 120)))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = word()
            data.append((len(data) * 3 + 1, " ".join(copy) + (f"\n{line}" if rng.random() < 0.2 else "")))
    data += [(1000, None), (1001, ""), (1002, "A B c"), (1003, "a  b\tC"), (1004, " ")]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in data]
    want = _brute_links(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b))
    docs = docs_of(spark, [(i, t, "s") for i, t in data] + [(None, "left out", "s"), (1, data[0][1], "again")])
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = []
    for k in range(260):
        v = centres[k % 12] + rng.normal(size=16) * rng.choice((0, 0.05, 0.12, 0.2, 2.0))
        data.append((k * 2 + 5, [float(x) for x in v]))
    odd = [(1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, [None] * 16), (None, data[0][1]), (9999, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "e", 1) for i, v in data + odd], "vec_id long, embedding array<double>, id string, label int")
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    want = _brute_links([(i, k) for k, (i, _) in enumerate(data)], lambda a, b: cos[a, b] >= 0.95)
    got = {r.id: r for r in embeddings.near_duplicates(df).collect()}
    for k, (i, _) in enumerate(data):
        assert (got[i].n_links, got[i].component_id) == ((cos[k] >= 0.95).sum() - 1, want[i])
        assert got[i].kept == (i == want[i])
    for i, _ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_dense_clumps_that_link_are_one_component(spark):
    # Two clumps of 60, cosines about 0.999 inside and 0.96 across: no list of nearest neighbours leads out of a clump.
    rng = np.random.default_rng(8)
    centres = np.zeros((2, 32))
    centres[0, 0], centres[1, :2] = 1, (0.9605, np.sqrt(1 - 0.9605**2))
    x = np.concatenate([c + rng.normal(size=(60, 32)) * 0.004 for c in centres])
    x = np.concatenate([x, rng.normal(size=(80, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    data = [(k + 3, [float(v) for v in row]) for k, row in enumerate(x)]
    want = _brute_links([(i, k) for k, (i, _) in enumerate(data)], lambda a, b: cos[a, b] >= 0.95)
    assert want[data[60][0]] == 3
    got = {r.id: r for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    for k, (i, _) in enumerate(data):
        assert (got[i].n_links, got[i].component_id) == ((cos[k] >= 0.95).sum() - 1, want[i])


def test_chained_clumps_link_over_all_parts(spark, monkeypatch):
    # Six clumps of 40, each linked with the next only, dealt over many parts and blocks: nothing stops before the last link.
    for name, value in (("ROWS", 16), ("BLOCK", 32), ("PARTITION", 50), ("PART", 1000)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rng, angle = np.random.default_rng(12), np.arccos(0.9605)
    x = np.concatenate([np.r_[np.cos(k * angle), np.sin(k * angle), np.zeros(22)] + rng.normal(size=(40, 24)) * 0.004 for k in range(6)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, order = unit @ unit.T, rng.permutation(len(x))
    data = [(int(order[k]), [float(v) for v in row]) for k, row in enumerate(x)] + [(1000, [1.0, 0.0]), (1001, [2.0, 0.1])]
    got = {r.id: r for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    for k in range(len(x)):
        assert (got[order[k]].n_links, got[order[k]].component_id) == ((cos[k] >= 0.95).sum() - 1, 0)
    assert [(got[i].n_links, got[i].component_id) for i in (1000, 1001)] == [(1, 1000)] * 2


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").isEmpty()
