"""SimHash links of rows without identifiers, and the tries that a number of fingerprints calls for."""

import random

import numpy as np
import pytest

from darkslide.llm import simhash


def components(rows):
    """(doc_id, bits) -> each row's component, by comparing all rows."""
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j, (_, b) in enumerate(rows) if (a ^ b).bit_count() <= 3) for i, (_, a) in enumerate(rows)]
    ids = {}
    for (i, _), g in zip(rows, label):
        ids.setdefault(g, []).append(i)
    return [min((i for i in ids[g] if i is not None), default=None) for g in label]


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_rows_without_an_id_link_like_any_other(spark, blocks, monkeypatch):
    r = random.Random(blocks)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = [(5, 0b0), (None, 0b111), (9, 0b111111), (None, 1 << 63), (None, 2**64 - 1)]  # a bridge; a row with a partner; one alone
    rows += [(r.choice([None, 100 + k]), r.choice(base) ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))})) for k in range(90)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d: d)
    monkeypatch.setattr(simhash, "tries_for", lambda n, f=simhash.tries_for: f(simhash.PART << {4: 16, 5: 25, 6: 30}[blocks]))
    df = spark.createDataFrame([(i, signed(b)) for i, b in rows], "doc_id long, bits long")
    got = [(x["doc_id"], x["bits"] % 2**64, x["component_id"]) for x in simhash.simhash_components(df).collect()]
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=order) == sorted(((i, b, c) for (i, b), c in zip(rows, components(rows))), key=order)


def test_a_subtree_fits_a_task_at_any_count():
    for n, blocks in ((10, 4), (10**7, 4), (10**9, 5), (10**10, 5), (10**12, 6)):
        tries = simhash.tries_for(n)
        assert len(tries.widths) == blocks and sum(tries.widths) == 64 and n / 2**tries.top <= simhash.PART


def test_tries_put_each_pair_within_the_budget_on_a_common_path(spark):
    r = random.Random(1)
    pairs = [(a := r.getrandbits(64), a ^ sum({1 << r.randrange(64) for _ in range(3)})) for _ in range(200)]
    for n in (10, 10**9, 10**12):
        tries = simhash.tries_for(n)
        df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
        row = df.select(*(tries.turned(df[c], k).alias(f"{c}{k}") for c in "ab" for k in range(len(tries.orders)))).collect()
        for x in row:
            x = {k: np.uint64(v % 2**64) for k, v in x.asDict().items()}
            assert any(x[f"a{k}"] >> np.uint64(64 - tries.top) == x[f"b{k}"] >> np.uint64(64 - tries.top) for k in range(len(tries.orders)))
            assert all(int(x[f"a{k}"]).bit_count() == int(x["a0"]).bit_count() for k in range(len(tries.orders)))
