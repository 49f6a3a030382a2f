"""Each operator against a brute-force version, and on rows that are odd in every way."""

import itertools
import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from darkslide.llm import chat, ctw, decontam, graph, html, langid, lattice, licences, packing, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bits string, block int, component_id long, _gone long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and extra columns with the operators' own names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "a plain text of some words", "en", "s"), (1, "a plain text of some words", "en", "s"), (2, None, None, None), (None, "no id here", "en", "s"), (None, None, None, None), (3, "", "en", "s"), (4, "  \n\t ", "", ""), (5, long, "en", "t"), (6, "Ünïcödé 漢字 👍🏽   <|endoftext|> x", "de", "t"), (7, "x", "en", "t")]
    return spark.createDataFrame([(*r, 1, "z", 0, 9, None) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(n=None):
    return pd.read_parquet(f"{SF}/documents.parquet").head(n or 10**9)


def pack(df, **k):
    return packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, **k)


def check_pieces(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids)] += 1
    starts = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert starts == want
    sizes, places = Counter(), {}
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert max(sizes.values()) <= capacity
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
    return sum(0 if s & (s - 1) == 0 else capacity - s for s in sizes.values())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents()
    rows = queries.op1_packing(spark, SF).collect()
    assert check_pieces(rows, list(zip(docs.doc_id, docs.text))) == 0
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in zip(docs.doc_id, docs.text)}
    covered = Counter()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]] += r["length"]
    assert all(covered[i] == len(x) for i, x in ids.items())


def test_packing_odd(odd, none):
    rows = pack(odd).collect()
    assert check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd.collect()]) == 0
    assert pack(none).collect() == []


def test_word_ids_equal_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.WordIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    r = random.Random(5)
    texts = []
    for _ in range(400):
        texts.append(text := "".join(r.choice(("a", "Zé", " ", " ", "  ", "\n", "\t", "'s", " 'll", "12", "!?", "漢", " ", "<|endoftext|>", "the", "\x1c", "👍", "\u3000", "\x85")) for _ in range(r.randint(0, 25))))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    texts += ["", " ", "\n", "one", "x " * 3000 + "y", "a\nb c" * 900]
    for together in (40, packing.TOGETHER):  # many texts at once, and texts cut at spaces
        monkeypatch.setattr(packing, "TOGETHER", together)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids_of(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_vector_packing_keeps_all_limits(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 1300) if r.random() > 0.05 else None, r.randint(0, 500)) for i in range(600)] + [(None, 5, 5)]
    limits = packing.Limits(1024, 4, 600)
    got = packing.pack_examples(spark.createDataFrame(rows, "k int, t int, l int"), "k", "t", "l", limits).collect()
    assert len(got) == len(rows)
    size = {k: (t or 0, min(t or 0, n)) for k, t, n in rows}
    by = {}
    for g in got:
        if g["sequence_id"] is None:
            assert size[g["id"]][0] == 0
        elif not g["oversize"]:
            by.setdefault(g["sequence_id"], []).append(size[g["id"]])
    assert all(sum(t for t, _ in s) <= 1024 and len(s) <= 4 and sum(n for _, n in s) <= 600 for s in by.values())
    assert sum(t for s in by.values() for t, _ in s) / (len(by) * 1024) > 0.75


def brute_components(keys, near):
    label = list(range(len(keys)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(keys))]


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = documents()
    r = random.Random(1)
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    for k in range(60):  # near copies: long texts with a word changed
        w = rows[r.randrange(len(rows))][1].split()
        if len(w) > 300:
            w[r.randrange(len(w))] = "changed"
            rows.append((10_000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in simhash.simhash_components(df).collect()}
    keys = [slow_fingerprint(t) for _, t in rows]
    assert all(got[i]["bits"] % 2**64 == k for (i, _), k in zip(rows, keys))
    label = brute_components(keys, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for (i, _), g in zip(rows, label):
        groups.setdefault(g, []).append(i)
    assert any(len(g) > 1 for g in groups.values())
    assert {i: x["component_id"] for i, x in got.items()} == {i: min(g) for g in groups.values() for i in g}
    kept = {x["doc_id"] for x in simhash.simhash_dedup(df).collect()}
    assert kept == {min(g) for g in groups.values()}


@pytest.mark.parametrize("part", [1024, 8])
def test_trie_pairs_and_dealt_cells(spark, part, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    keys = np.unique(np.array([b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) for b in base for _ in range(40)], np.uint64))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 3 and keys[i] >> np.uint64(48) == keys[j] >> np.uint64(48)}
    starts = np.append(np.flatnonzero(np.append(True, (keys[1:] >> np.uint64(48)) != (keys[:-1] >> np.uint64(48)))), len(keys))
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(keys, starts, 48, 3) for a, b in zip(i, j)}
    assert got == want
    monkeypatch.setattr(simhash, "fingerprints", lambda d: d.select("doc_id", "bits"))
    df = spark.createDataFrame([(i, int(k.view(np.int64))) for i, k in enumerate(keys)], "doc_id long, bits long")
    label = brute_components([int(k) for k in keys], lambda a, b: (a ^ b).bit_count() <= 3)
    assert {x["doc_id"]: x["component_id"] for x in simhash.simhash_components(df).collect()} == dict(enumerate(label))


def test_simhash_odd(odd, none):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count() and {r["component_id"] for r in rows if r["bits"] == 0} == {2}
    assert sorted(r["doc_id"] for r in simhash.simhash_dedup(odd).collect() if r["doc_id"] is not None) == [1, 2, 5, 6, 7]
    assert simhash.simhash_dedup(odd).columns == odd.columns
    assert simhash.simhash_components(none).collect() == [] and simhash.simhash_dedup(none).collect() == []


@pytest.mark.parametrize(("part", "listed"), [(512, 10**6), (4, 0)])
def test_pipeline_drops_near_copies_from_0_8(spark, odd, none, part, listed, monkeypatch):
    import corpus_pipeline
    from darkslide.llm import shingles

    monkeypatch.setattr(shingles, "PART", part)
    monkeypatch.setattr(shingles, "LISTED", listed)
    r = random.Random(7)
    base = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(100, 600))) for _ in range(40)]
    rows = list(enumerate(base))
    for k in range(160):  # copies with some words replaced, at similarities from 0.5 to 1
        w = r.choice(base[:25]).split()
        for _ in range(r.randint(0, len(w) // 20)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))

    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    label = brute_components(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    groups = {}
    for (i, _), g in zip(rows, label):
        groups.setdefault(g, []).append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()} == {min(g) for g in groups.values()}
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == [1, 2, 5, 6, 7] and kept.where("doc_id is null").count() == 2
    assert corpus_pipeline.drop_near_duplicates(spark, none, SF).collect() == []


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = brute_components(nodes, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    assert got == {n: nodes[k] for n, k in zip(nodes, want)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def e8_roots():
    """The 240 shortest vectors of E8."""
    whole = [tuple(s if k == i else t if k == j else 0.0 for k in range(8)) for i in range(8) for j in range(i) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half)


def test_e8_decoding():
    roots = e8_roots()
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(x)
    doubled = np.rint(2 * near).astype(int)
    assert np.allclose(doubled, 2 * near) and ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all() and (np.rint(near.sum(axis=1)).astype(int) % 2 == 0).all()
    gap = ((x - near) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all() and all((((x - near - v) ** 2).sum(axis=1) >= gap - 1e-9).all() for v in roots)
    assert len(roots) == 240 and np.allclose((x * lattice.nearest_root(x)).sum(axis=1), (x @ roots.T).max(axis=1)) and {tuple(v) for v in lattice.nearest_root(x)} <= {tuple(v) for v in roots}


def test_cells_do_not_depend_on_the_vectors_beside():
    v = lattice._unit(np.random.default_rng(3).normal(size=(500, 64)).astype(np.float32))
    lab = np.arange(500) % 3
    alone = np.concatenate([lattice.cells(v[i : i + 1], lab[i : i + 1], lattice.Lattice()) for i in range(0, 500, 7)])
    assert (lattice.cells(v, lab, lattice.Lattice())[::7] == alone).all()


@pytest.mark.parametrize("part", [512, 16])
def test_lattice_against_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(lattice, "PART", part)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        center = rng.normal(size=32)
        for k in range(int(rng.integers(1, 40))):
            v = center + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(c % 3)))
    odd = [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [None] + [1.0] * 31, 1), (9004, [float("nan")] * 32, 1), (9005, [], 1), (9006, rows[0][1], None), (None, rows[0][1], 0), (9007, [float("inf")] + [1.0] * 31, 0), (9008, rows[0][1][:8], 0), (9009, rows[1][1], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: x for x in lattice.near_vectors(df, 0.93).collect()}
    assert len(got) == len(rows) + len(odd)
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(rows))) and found >= 0.95 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007))
    assert got[None]["n_links"] == 0 and all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values() if x["vec_id"] is not None)
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_lattice_labels_of_any_type(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, "a"), (2, v, "a"), (3, v, "b"), (4, v, None), (5, [1.0, 2.0, 3.01], "b")], "vec_id long, embedding array<double>, label string")
    assert {(x["vec_id"], x["n_links"], x["component_id"]) for x in lattice.near_vectors(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (5, 1, 3), (4, 0, 4)}


def test_lattice_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(50, [1.0, 2.0, 3.01], 1)], "vec_id long, embedding array<double>, label int")
    rows = lattice.near_vectors(df).collect()
    assert {(x["n_links"], x["component_id"]) for x in rows} == {(50, 0)}


def test_ctw_base_and_score(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_ctw(spark, sf).collect()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(docs.doc_id, docs.text)}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    for held in (False, True):  # on this little text the words' counts are as good; from 20 MB on the score is better on both
        some = [r for r in rows if r["held_out"] == held]
        assert some and sum(r["score"] for r in some) > 1.03 * sum(r["base_score"] for r in some)


def slow_ctw(train, texts):
    """The weighting by its definition, with a dictionary of nodes."""
    counts = {}
    seqs = lambda t: [(bytes([ctw.END]) * ctw.DEPTH + b" ".join(ctw.words_of(t)) + bytes([ctw.END]))][0]
    for t in train:
        s = seqs(t)
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                place, bit = (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault((s[i - d : i], place), [0, 0])[bit] += 1
    kids = {}
    for c, place in counts:
        if c:
            kids.setdefault((c[1:], place), []).append((c, place))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node):
        if node not in memo:
            e = kt(*counts[node])
            memo[node] = e if len(node[0]) == ctw.DEPTH else np.logaddexp(e, sum(weighted(x) for x in kids.get(node, []))) - math.log(2)
        return memo[node]

    def p(s, i, d, place, bit):
        a, b = counts.get((s[i - d : i], place), (0, 0))
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return own
        node = (s[i - d : i], place)
        if (s[i - d - 1 : i], place) not in counts:
            return own
        alpha = math.exp(kt(a, b) - math.log(2) - weighted(node))
        return alpha * own + (1 - alpha) * p(s, i, d + 1, place, bit)

    out = []
    for t in texts:
        s = seqs(t)
        out.append(sum(math.log10(p(s, i, 0, (1 << k) | (s[i] >> (8 - k)), s[i] >> (7 - k) & 1)) for i in range(ctw.DEPTH, len(s)) for k in range(8)))
    return out


def test_ctw_against_its_definition(spark):
    texts = ["the cat sat on the mat", "the dog sat", "A cat  and\na dog", "", None, "völlig anders 漢", "the cat sat on the dog", "zzz"]
    df = spark.createDataFrame([(i, t, i < 6) for i, t in enumerate(texts)], "doc_id long, text string, t boolean").repartition(3)
    df = df.sparkSession.createDataFrame(sorted(df.collect(), key=lambda r: r["doc_id"]), df.schema)
    got = {r["doc_id"]: r["score"] for r in ctw.score_texts(df, F.col("t")).collect()}
    for i, want in enumerate(slow_ctw(texts[:6], texts)):
        assert math.isclose(got[i], want, rel_tol=1e-9), i


@pytest.mark.parametrize(("depth", "block"), [(3, 40), (6, 1), (7, 10**6)])
def test_ctw_of_other_depths_and_blocks(spark, depth, block, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat", "A cat  and\na dog", "", None, "the cat sat on the dog " * 5, "zzz", "the mat"]
    df = spark.createDataFrame([(i, t, i < 6) for i, t in enumerate(texts)], "doc_id long, text string, t boolean").coalesce(2)
    got = {r["doc_id"]: r for r in ctw.score_texts(df, F.col("t"), depth, block).collect()}
    monkeypatch.setattr(ctw, "DEPTH", depth)
    for i, want in enumerate(slow_ctw(texts[:6], texts)):
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9), i
        assert math.isclose(got[i]["bits_per_byte"], -want / math.log10(2) / (len(b" ".join(ctw.words_of(texts[i]))) + 1), rel_tol=1e-9)


def test_ctw_odd(odd, none):
    rows = ctw.score_texts(odd, F.col("doc_id") != 7).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)
    assert ctw.score_texts(none, F.lit(True)).collect() == []
    assert len(ctw.score_texts(odd, F.lit(False)).collect()) == odd.count()


def test_toxicity(spark):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    m = rows.merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    held = m[m.held_out]
    right = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert held.toxic.sum() > 50 and right >= 0.8 * held.toxic.sum() and right >= 0.9 * held.predicted.sum()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()


def every_reading(token, model, breaks, cost):
    """All words that a token may hide with the score of each, by going through the whole lattice."""
    three = model.three.astype(float)
    cls = lambda c: int(toxicity.classes(c)[0])
    paths = [(0.0, 0, 0, "")]
    for m in re.finditer(r"(.)\1*", token):
        c, run = m[1], len(m[0])
        ends = lambda cost: [*paths, *((s + three[a, b, 0] + cost, b, 0, t + " ") for s, a, b, t in paths if b)]
        if c in toxicity.SEPARATORS:
            paths = ends(0.0) if c in breaks else paths
            continue
        if not (letters := toxicity.STANDS_FOR.get(c, c if c.isalpha() else "")):
            continue
        paths = ends(cost) if breaks == toxicity.SPELT else paths
        new = []
        for s, a, b, t in paths:
            for x in letters:
                k = cls(x)
                one = s + three[a, b, k] - math.log(len(letters))
                new.append((one + (0.0, toxicity.ONCE, -0.7)[min(run, 3) - 1], b, k, t + x))
                if run > 1:
                    new.append((one + three[b, k, k] - (0.0 if run == 2 else 0.7), k, k, t + 2 * x))
                    if breaks == toxicity.SPELT:
                        new.append((one + three[b, k, 0] + three[k, 0, k] + cost, 0, k, f"{t}{x} {x}"))
        paths = new
    return [(s + three[a, b, 0], t.strip()) for s, a, b, t in paths]


def test_viterbi_finds_the_likeliest_reading():
    r = random.Random(9)
    model = toxicity.CharModel.of(np.random.default_rng(1).integers(0, 40, 64**3))
    for _ in range(400):
        token = "".join(r.choice("ab1!.-sslß漢6$") * r.choice((1, 1, 1, 2, 3)) for _ in range(r.randint(1, 6)))
        for breaks, cost in (("", 0.0), (toxicity.SEPARATORS, 0.0), (toxicity.SPELT, -1.5)):
            if breaks == toxicity.SPELT and len(token) > 7:
                continue
            best, said = max(every_reading(token, model, breaks, cost))
            got = toxicity.decode(token, model, breaks, cost)
            assert any(abs(s - best) < 1e-4 for s, t in every_reading(token, model, breaks, cost) if t == got), (token, got, said)


def test_words_out_of_reach_give_none_of_the_features():
    r = random.Random(4)
    model = toxicity.CharModel.of(np.random.default_rng(2).integers(0, 9, 64**3))
    known = {f: 1.0 for w in ("letter", "abba", "coffee", "mississippi") for f in toxicity.features_of(w)}
    words = ["".join(r.choice(("l", "e", "t", "tt", "r", "a", "bb", "b", "m", "i", "ss", "s", "pp", "c", "o", "ff", "ee", "f")) for _ in range(r.randint(2, 9))) for _ in range(3000)] + list("letter leter lletter abba aba coffee cofee misisippi lettering".split())
    reach = toxicity.Reach(known)
    for w in words:
        assert toxicity._doc_features(w, model, {}, known) == toxicity._doc_features(w, model, {}, known, reach), w


def test_many_texts_at_once_give_the_same_features():
    r = random.Random(8)
    model = toxicity.CharModel.of(np.random.default_rng(3).integers(0, 9, 64**3))
    known = {f: 1.0 for w in ("stupid", "idiot", "loser", "a", "ab", "слово", "straße") for f in toxicity.features_of(w)}
    parts = ["stupid", "idiot", "loser", "l0ser", "stuupid", "id-iot", "i", "d", "o", "t", "a", "b", "!", ",", ".", "(", "*", "-", "слово", "straße", "ẞ", "é", "1", "$", " ", " ", " ", "\n", "\x1c", "\u3000", "\x85", "👍", "_", "'"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "i d i o t　l o s e r", "a! b? c", "x " * 5000 + "s t u p i d"]
    reach = toxicity.Reach(known)
    assert toxicity._Finder(model, known)(texts) == [toxicity._doc_features(t, model, {}, known, reach) for t in texts]
    assert toxicity._Finder(model, {})(texts) == [set()] * len(texts) and toxicity._Finder(model, known)([]) == []


def test_one_alphabet_for_all_scripts():
    assert toxicity.classes("aß漢ж👍 -").tolist() == [1, 27, 63, 63, 63, 0, 0]
    model = toxicity.CharModel.of(np.ones(64**3))
    long = "ж1" * 30_000
    assert len(toxicity.decode(long, model)) == 60_000 and toxicity.words_of("слово", model) == ["слово"]


def test_logistic_regression_against_a_plain_optimiser():
    g = np.random.default_rng(0)
    x = (g.random((300, 5)) < 0.4).astype(float)
    y = (g.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5, 0, 1] - 1)))).astype(float)
    w, bias = np.zeros(5), 0.0
    for _ in range(20_000):  # plain gradient descent
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        w, bias = w - 0.5 * (x.T @ (p - y) / 300 + 1e-5 * w), bias - 0.5 * (p - y).mean()
    row, col = np.nonzero(x)
    got, b = toxicity._fit(row, col, y, 5)
    assert np.allclose(got, w, atol=0.05) and abs(b - bias) < 0.05


def test_toxicity_undoes_disguises(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    chars = toxicity.CharModel.of(toxicity.char_counts(spark.createDataFrame(docs)))
    for token, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("l0ser", "loser"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("d1sgu5ting", "disgusting")):
        assert word in toxicity.words_of(token, chars)
    assert "idiot" in toxicity.restore("what an i d i o t you are", chars).split()
    assert toxicity.words_of("plain", chars) == ["plain"] and toxicity.words_of("123456", chars) == ["123456"] and toxicity.words_of("$$$", chars) == []


def test_toxicity_undoes_doubled_letters_single_separators_and_spelt_phrases(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    chars = toxicity.CharModel.of(toxicity.char_counts(spark.createDataFrame(docs)))
    for token, word in (("stuupid", "stupid"), ("iidiot", "idiot"), ("lloser", "loser"), ("id-iot", "idiot"), ("id.iot", "idiot"), ("st_upid", "stupid")):
        assert word in toxicity.words_of(token, chars), token
    assert "well" in toxicity.words_of("well-known", chars) and "letter" in toxicity.words_of("letter", chars)
    for text, words in (("you s t u p i d i d i o t", {"stupid", "idiot"}), ("l o s e r m o r o n", {"loser", "moron"}), ("s t u u p i d", {"stupid"}), ("f a t", {"fat"})):
        assert words <= set(toxicity.spaced(text, chars)), text
    assert toxicity.restore("you s t u u p i d", chars) == "you stupid"
    assert {"stupid", "idiot"} <= toxicity._doc_features("s t u p i d i d i o t", chars, {})
    assert toxicity.restore("1 2 3 4 and 5", chars) == "1 2 3 4 and 5"
    assert "".join(toxicity.restore(" ".join("moron" * 40), chars).split()) == "moron" * 40


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None), (7, 7)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels, apart=0.5)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] >= 0.5 for r in rows if r["doc_id"] == 1} == {True} and toxicity.drop_toxic(odd, model).columns == odd.columns
    empty = toxicity.fit_toxicity(none, labels.limit(0))
    assert toxicity.score_toxicity(none, empty).collect() == [] and toxicity.drop_toxic(odd, empty).count() == odd.count()


def test_html_pages(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op7_html(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, h in zip(pages.page_id, pages.html):
        text = got[i]["text"]
        assert text and got[i]["n_chars"] == len(text) and "©" not in text and "var t" not in text and "<" not in text
        title = " ".join(h.split("<h1>")[1].split("</h1>")[0].replace("&amp;", "&").split())
        assert text.startswith(title.replace("&quot;", '"').replace("&am", "&am")[:20])


@pytest.fixture(scope="module")
def extractor():
    return html.fit_extractor(200)


def test_html_layouts(extractor):
    p = "<p>{} A sentence of the article, which is long enough to be one. Another one follows it here.</p>"
    page = f"""<html><head><title>no</title></head><body><div class="cookie-notice">We use cookies to improve it all. <button>ok</button></div><header><a href="/">Site</a><p>Our tagline</p></header>
    <nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul></nav><main><article><h1>Title &amp; more</h1>{p.format("First")}{p.format("Second&nbsp;&eacute;")}<div class="ad">Buy this now!</div>{p.format("Third")}</article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=d>Four</a></li><li><a href=e>Five</a></li></ul></aside><form><label>Mail</label><input><button>Go</button></form>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>Ann</p><p>I liked the article very much, thank you.</p></div></section><footer>&copy; 2024 Site. All rights.</footer></body></html>"""
    text = extractor.texts([page])[0].split("\n\n")
    assert text[0] == "Title & more" and [t.split(" ")[0] for t in text[1:]] == ["First", "Second", "Third"] and "é" in text[2]


def test_html_parser_and_decoding(extractor):
    page = html.parse("<p>a<p>b <b>c<br>d</p>e<ul><li>x<li>y</ul><script>if (a<b) '</p>'</script>&lt;t&gt; 1 < 2<!-- c --> end")
    assert page.texts() == ["a", "b c d", "e", "x", "y", "<t> 1 < 2 end"]
    r = np.random.default_rng(0)
    maker = html._Maker(3)
    for _ in range(40):
        page = html.parse(maker.page())
        main = html.decoded(page, r.random(len(page.tag)))
        assert len(main) == len(page.tag)
    for bad in ("", "<", "<p", "</p>", "<div " * 50, "<b>" * 3000 + "x", "<p>" * 2000, "&#xFFFFFFFF; &#0;", "\x00<a href='", "<table><td>x<td>y", "<script>never closed"):
        assert isinstance(extractor.texts([bad])[0], str)


def test_html_odd(spark, extractor):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article><p>Some text, really.</p></article>", 3), (2, "u", "<article><p>Some text, really.</p></article>", 3)], "page_id long, url string, html string, text int")
    rows = html.extract_pages(df, extractor).collect()
    assert len(rows) == 4 and [r["n_chars"] for r in rows if r["url"] is None] == [0]
    assert html.extract_pages(df.limit(0), extractor).collect() == []


def test_language(spark):
    got = queries.op2_langid(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.language == got.declared).mean() > 0.97 and got.probability.between(0, 1.0000001).all()


def test_language_evidence(spark):
    model = langid.fit_text_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    none = (None,) * 4
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    german = docs[docs.lang == "de"].text.iloc[0]
    rows = [(1, german, "fr", None, None, None), (2, "", "fr", None, None, None), (3, None, *none), (4, "x", None, "de", "a.de", "h.a.de"), *[(10 + i, docs[docs.lang == "fr"].text.iloc[i], "fr", "fr", "b.fr", "w.b.fr") for i in range(30)], (50, None, None, "fr", "b.fr", "w.b.fr")]
    got = {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string"), model).collect()}
    assert len(got) == len(rows) and got[1]["language"] == "de" and got[1]["text_language"] == "de"
    assert got[2]["language"] == "fr" and got[50]["language"] == "fr" and got[3]["text_language"] is None


def test_language_odd(spark, odd, none):
    kept = langid.keep_declared(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2
    assert langid.keep_declared(none).collect() == []
    pages = spark.createDataFrame([(1, None, None), (2, "http://[", "<html lang=>"), (3, "https://u@Host.Example.ORG:80/x", "<HTML class=a LANG='en-GB'>hi")], "page_id long, url string, html string")
    rows = {r["id"]: r for r in langid.page_rows(pages).collect()}
    assert (rows[3]["host"], rows[3]["domain"], rows[3]["suffix"], rows[3]["declared"]) == ("host.example.org", "example.org", "org", "en") and rows[1]["host"] is None
    assert len(langid.identify(langid.page_rows(pages), langid.fit_text_model(none)).collect()) == 3


def test_licences(spark):
    docs = documents()
    rows = queries.op6_licences(spark, SF).collect()
    want = {(i, k) for i, t in zip(docs.doc_id, docs.text) for k, line in enumerate((t or "").split("\n")) if "Licens" in line or "License" in line}
    assert {(r["doc_id"], r["paragraph"]) for r in rows} == want and all(r["confirmed"] for r in rows)


def test_licence_families(odd, none):
    model = licences.fit_licences()
    unknown = model.probabilities(licences.words_of("the terms of the version of a public file"))
    assert unknown[-1] >= licences.SURE > unknown[:-1].max() and model.probabilities(licences.words_of("released under the mit license"))[-1] < licences.SURE
    for text, family in (("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2.0"), ("// Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd")):
        found = licences.scan(f"first\n{text}\nlast", model, {})
        assert [(f[0], f[1]) for f in found] == [(1, family)] and found[0][3] >= licences.CONFIRMS and found[0][5] < 0.5, text
    assert licences.scan("the driver's license is expired\nthe terms of the version", model, {}) == [] and licences.scan(None, model, {}) == []
    assert licences.find_licences(odd, model).count() == 0 and licences.find_licences(none, model).count() == 0


def test_licences_held_out():
    """Made-up paragraphs of another seed: families and none, and how far the calibrated probabilities can be believed."""
    model, rows = licences.fit_licences(), licences._made(random.Random(777), 60)
    p = np.array([model.probabilities(w) for w, _ in rows])
    y = np.array([f if f >= 0 else p.shape[1] - 1 for _, f in rows])
    best = [f if len(f := licences.sure_of(q)) else [p.shape[1] - 1] for q in p]
    right = np.array([t in b for t, b in zip(y, best)])
    assert right[y < p.shape[1] - 1].mean() > 0.93 and right[y == p.shape[1] - 1].mean() > 0.97
    for lo, hi in ((0.0, 0.2), (0.8, 1.01)):  # the class of none is calibrated
        some = (p[:, -1] >= lo) & (p[:, -1] < hi)
        assert abs(p[some, -1].mean() - (y[some] == p.shape[1] - 1).mean()) < 0.05


def test_licences_wrapped_at_eighty_columns():
    model = licences.fit_licences()
    for family in ("mit", "gpl-3.0", "bsd", "apache-2.0", "lgpl"):
        notice = max(licences.TEMPLATES[family], key=len)
        said = "\n".join(f"// {line}" for line in textwrap.wrap(notice, 60))
        found = [f for f in licences.scan(f"int main() {{}}\n\n{said}\n\nreturn 0;", model, {}) if f[1] == family]
        assert len(found) == 1 and found[0][0] == 2 and found[0][3] >= 0.99 and found[0][4] == said, family


def test_licences_after_long_lines():
    r = random.Random(2)
    mit, bsd = licences.TEMPLATES["mit"][2], licences.TEMPLATES["bsd"][0]
    for text, family in ((mit, "mit"), (bsd, "bsd")):
        for n in range(0, 400, 7):
            before = [r.choice(("the", "of", "software", "in")) if r.random() < 0.05 else f"mot{r.randrange(99)}" for _ in range(n)]
            assert licences.compare([*before, *licences.words_of(text), "fin"], family) == 1.0


def test_licences_wrapped_and_dual():
    model = licences.fit_licences()
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    found = licences.scan(f"intro\n\nfirst\n{bsd}\nlast\n\nend", model, {})
    assert [(f[0], f[1], f[3], f[4]) for f in found] == [(3, "bsd", 1.0, bsd)]
    twice = licences.scan(f"{bsd}\nx\n{bsd}", model, {})
    assert [(f[0], f[1], f[3]) for f in twice] == [(0, "bsd", 1.0), (3, "bsd", 1.0)]
    dual = licences.scan("x\nLicensed under the MIT license or the Apache License, Version 2.0", model, {})
    assert {(f[0], f[1], f[3]) for f in dual} == {(1, "mit", 1.0), (1, "apache-2.0", 1.0)}


def test_decontamination(spark):
    docs, bench = documents(), pd.read_parquet(f"{SF}/benchmark.parquet")
    r = random.Random(8)
    planted = []
    for k, (i, t) in enumerate(zip(bench.item_id, bench.text)):
        w = t.split()
        if len(w) > 20:  # a paraphrase: some words dropped, one swapped
            w = [x for x in w if r.random() > 0.1]
            host = docs.text.iloc[k].split()[:400]
            at = r.randrange(len(host) + 1)
            planted.append((50_000 + k, " ".join(host[:at] + w + host[at:]), i))
    df = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text), *((i, t) for i, t, _ in planted)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_contamination(df, spark.createDataFrame(bench)).collect()}
    exact = {(i, b) for i, t in zip(docs.doc_id, docs.text) for b, q in zip(bench.item_id, bench.text) if " ".join(q.split()) in " ".join(t.split())}
    assert exact <= got and sum((i, b) in got for i, _, b in planted) >= 0.9 * len(planted)
    words = {b: decontam.words_of(t) for b, t in zip(bench.item_id, bench.text)}
    text = dict(df.collect())
    assert all(decontam.lcs(words[b], decontam.words_of(text[i])) >= 0.6 * len(words[b]) for i, b in got)


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a plain text"), (3, "no id here"), (4, "word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7 word8x8")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(odd, bench).collect()}
    assert (None, 3) in got and (5, 4) in got
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and 5 not in {r["doc_id"] for r in kept.collect()} and kept.where("doc_id is null").count() == 2
    assert decontam.find_contamination(none, bench).collect() == [] and decontam.find_contamination(odd, bench.limit(0)).collect() == []
    assert decontam.lcs([1, 2, 3, 2], [2, 1, 3, 9, 2]) == 3 and decontam.lcs([], [1]) == 0


def search(items, texts, words=None):
    """What a searcher finds whose latent space says nothing: only shared words in a row give candidates."""
    words = words or sorted({w for _, x in items for w in x})
    latent = decontam.Latent(words, np.ones(len(words) + 1), 1.0, np.zeros((len(words) + 1, 2)))
    known = {w: i + 1 for i, w in enumerate(words)}
    return decontam._Searcher(latent, items, decontam.Thresholds()).batch([np.array([known.get(w, 0) for w in t], np.int64) for t in texts])


def test_decontamination_finds_verbatim_items_without_the_cosine():
    r = random.Random(3)
    items = [(i, [f"v{r.randrange(900)}" for _ in range(r.randint(1, 60))]) for i in range(300)]
    filler = lambda: [f"v{r.randrange(900)}" if r.random() < 0.5 else "-" for _ in range(r.randint(0, 200))]
    texts = [filler() + w + filler() for _, w in items]
    got = {(d, i) for d, i, *_ in search(items, texts)}
    assert {(i, i) for i, _ in items} <= got and all(decontam.lcs(items[i][1], texts[d]) >= 0.6 * len(items[i][1]) for d, i in got)


def test_decontamination_of_long_items():
    for n in (64, 65, 70, 80, 100, 129, 140, 200):
        words = [f"v{i}" for i in range(n)]
        filler = ["-"] * 300
        hit = search([(1, words)], [filler + words + filler, filler + words[:64] + filler if n > 107 else [], filler + [w for i, w in enumerate(words) if i % 10 < 7 or i >= n - 6] + filler, filler + [w for i, w in enumerate(words) if i % 10 < 7 and i < n - 6] + filler])
        found = {d: h for d, *h in hit}
        assert set(found) == {0, 2}, n  # neither a segment alone nor a paraphrase without the answer
        assert found[0][2] == 1.0 and found[2][3]


def call(i, name, args):
    return json.dumps({"tool_calls": [{"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args) if isinstance(args, dict) else args}}]})


def test_chat(spark):
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        ("c", 0, "user", "find it"), ("c", 3, "tool", result("b", "B")), ("c", 1, "assistant", call("b", "search", {"query": "$a", "limit": 3})), ("c", 2, "assistant", call("a", "search", {"query": ""})), ("c", 4, "tool", result("a", {"z": 1.0, "a": [True]})),
        ("c", 5, "assistant", call("x", "calculator", {"expression": "${y}", "more": 1})), ("c", 6, "assistant", call("y", "calculator", {"expression": "${x}"})), ("c", 7, "tool", result("lost", 1)), ("d", 0, "assistant", call("b", None, "not json")), (None, None, None, None), ("e", 1, "user", '{"broken'),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), queries.TOOLS).collect()
    assert len(got) == len(rows)
    of = {(r["conv_id"], r["kind"], r["call_id"]): r for r in got}
    assert of["c", "call", "a"]["level"] == 0 and of["c", "call", "b"]["level"] == 1 and of["c", "call", "x"]["level"] is None
    assert of["c", "call", "a"]["linked"] and of["c", "result", "b"]["linked"] and not of["c", "result", "lost"]["linked"] and not of["c", "call", "x"]["linked"]
    assert of["c", "call", "b"]["valid"] and of["c", "call", "a"]["errors"] == ["$.query: length"] and of["c", "call", "x"]["errors"] == ["$: more unknown"] and not of["d", "call", "b"]["valid"]
    assert of["c", "result", "a"]["message"] == '{"content":{"a":[true],"z":1},"role":"tool","tool_call_id":"a"}'
    order = [(r["kind"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == "c"), key=lambda r: r["order_key"])]
    assert order.index(("result", "b")) == order.index(("call", "b")) + 1 and order.index(("result", "a")) == order.index(("call", "a")) + 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).collect() == []


def test_chat_order_across_turns(spark):
    calls = {"b": (1, "$a"), "a": (2, "-"), "c": (0, "$b"), "d": (4, "$a"), "e": (3, "-"), "x": (5, "$y $a"), "y": (6, "$x")}
    rows = [("c", t, "assistant", call(i, "search", {"query": q})) for i, (t, q) in calls.items()] + [("c", 7, "tool", json.dumps({"tool_call_id": "a", "content": 1}))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    order = [(r["kind"], r["call_id"]) for r in sorted(got, key=lambda r: r["order_key"])]
    assert order == [("call", "a"), ("result", "a"), *(("call", i) for i in "bcedxy")]


@pytest.mark.parametrize("rounds", [0, 2])
def test_chat_long_chains(spark, rounds):
    n = 70
    rows = [("c", (i * 37) % n, "assistant", call(f"k{i}", "search", {"query": f"$k{i - 1} $k{i // 2}" if i else "-"})) for i in range(n)]
    rows += [("c", 99, "assistant", call("x", "search", {"query": "$y"})), ("c", 98, "assistant", call("y", "search", {"query": "$x"})), ("c", 97, "assistant", call("z", "search", {"query": "$y"}))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"), rounds=rounds).collect()
    assert {r["call_id"]: r["level"] for r in got} == {**{f"k{i}": i for i in range(n)}, "x": None, "y": None, "z": None}
    assert [r["call_id"] for r in sorted(got, key=lambda r: r["order_key"])][:n] == [f"k{i}" for i in range(n)]


def test_chat_table(spark):
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r for r in queries.op8_chat(spark, SF).collect()}
    assert len(got) == len(turns)
    assert all(json.loads(got[str(c), t]["message"]) == {"role": r, "content": x} for c, t, r, x in zip(turns.conv_id, turns.turn, turns.role, turns.text))


def test_schema_errors():
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}}, "additionalProperties": False}
    assert chat.errors_of({"a": 2.0, "b": ["x", 1]}, s) == [] and chat.errors_of({"a": None}, s) == []
    assert chat.errors_of({"a": 1, "b": ["y"], "c": 0}, s) == ["$.a: minimum", "$.b[0]: not in enum", "$: c unknown"]
    assert chat.errors_of([], s) == ["$: not object"] and chat.errors_of(True, {"type": "integer"}) == ["$: not integer"] and chat.errors_of(3, {"anyOf": [{"type": "string"}, {"minimum": 5}]}) == ["$: anyOf"]


def test_boosting():
    from darkslide.llm import boosting

    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x, y)
    z = r.normal(size=(1000, 5))
    assert ((model.probability(z) > 0.5) == ((z[:, 0] > 0.3) ^ (z[:, 1] > 0))).mean() > 0.95


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r for r in after.collect()}
        assert 0 < len(rows) <= before.count() and all(rows[r["doc_id"]] == r for r in before.collect() if r["doc_id"] in rows)
        before = spark.createDataFrame(list(rows.values()), docs.schema)
    kept = before.toPandas()
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert check_pieces(pieces, list(zip(kept.doc_id.tolist(), kept.text))) == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(kept.doc_id)
