"""Near duplicates of the pipeline: candidates come from SimHash tries, and no pair at 0.8 is lost there."""

import numpy as np

from darkslide.llm import shingles, simhash


def test_tries_of_wide_fingerprints_find_pairs_at_0_8():
    r = np.random.default_rng(1)
    prints, few = [], []
    for k in range(300):  # pairs of sets at 0.8 and little more, of 4 shingles and of many
        n = int(r.choice([4, 20, 36, 400]))
        ids = np.unique(r.integers(0, 2**32, n * 5 // 4, dtype=np.uint32))
        for x in (ids, ids[: -(-len(ids) * 4 // 5)]):
            prints.append(shingles.fingerprint(np.sort(x)))
            few.append(len(x) <= shingles.FEW)
    paths = shingles.paths_for(20_000)
    at = paths.subtrees(prints)
    walked = np.frombuffer(b"".join(p[: shingles.WALKED // 8] for p in prints), ">u8").astype(np.uint64).reshape(-1, 2)
    found = set()
    for t in range(at.shape[1]):
        rows = np.array([i for i in range(len(prints)) if t < paths.tries or few[i]])
        if len(rows):
            rows = rows[np.lexsort((walked[rows, 0], at[rows, t]))]
            starts = np.append(np.flatnonzero(np.append(True, np.diff(at[rows, t]) != 0)), len(rows))
            key, a, b = shingles.near_in_cells(rows.astype(np.int64), walked[rows, 0].copy(), walked[rows, 1].copy(), starts)
            found |= {(int(x), int(y)) for k, x, y in zip(key, a, b) if not k}
    assert sum((2 * k, 2 * k + 1) in found for k in range(300)) >= 298


def test_wide_trie_pairs_are_all_pairs_within_the_budget():
    r = np.random.default_rng(2)
    keys, rest = (r.integers(0, 2**64, 700, dtype=np.uint64) for _ in range(2))
    keys[350:], rest[350:] = keys[:350] ^ np.uint64(7 << 40), rest[:350] ^ np.uint64(1 << 63)
    order = np.argsort(keys)
    keys, rest = keys[order], rest[order]
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(keys, np.array([0, 700]), 64, 40, rest) for a, b in zip(i, j)}
    far = np.bitwise_count(keys[:, None] ^ keys).astype(int) + np.bitwise_count(rest[:, None] ^ rest)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= 40)) if i < j} and len(got) >= 350
