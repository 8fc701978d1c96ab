"""Groups of near copies: forests instead of stars, heap merging, blocks of large groups against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard


def components_of(pairs, names):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_forest():
    rng = random.Random(1)
    for _ in range(200):
        names = rng.sample(range(-1000, 1000), 40)
        pairs = np.array([(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 50))], np.int64).reshape(-1, 2)
        want = components_of(pairs.tolist(), names)
        got = dict(jaccard.forest(pairs).tolist())
        assert got == {n: r for n, r in want.items() if n != r}
    path = np.array([(i, i + 1) for i in range(5000)])
    assert (jaccard.forest(path)[:, 1] == 0).all()


def test_merge_skip():
    rng = random.Random(2)
    for _ in range(500):
        lists = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, len(lists))
        want = {m: c for m, c in Counter(m for part in lists for m in part).items() if c >= least}
        found, counts = jaccard.merge_skip(lists, least)
        assert dict(zip(found, counts)) == want and found == sorted(found)


def sets_of(texts, size=3):
    out = []
    for text in texts:
        w = text.split()
        out.append({tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def family(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(70)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(70)] = f"w{rng.random()}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size, threshold", [(3, (90, 100)), (5, (80, 100))])
def test_blocks_of_large_groups(spark, monkeypatch, size, threshold):
    """Blocks of five members: representatives, open sets and home blocks all take part."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 5)
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    texts = family(rng, words, 60, 3) + family(rng, words, 40, 1) + family(rng, words, 30, 6) + family(rng, words, 8, 2) * 3
    # A chain: each a few words further, so that its ends are far apart.
    chain = [rng.choice(words) for _ in range(70)]
    for i in range(25):
        chain[2 * i] = f"c{i}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    sets = sets_of(texts, size)
    num, den = threshold
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = components_of(pairs, range(len(sets)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, size, threshold).collect()}
    assert got == want
    assert len(set(want.values())) > 3


def test_five_thousand_near_copies(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(500)]
    texts = [t for t in family(rng, words, 5000, 1)] + family(rng, words, 1, 0) * 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    members = len({frozenset(s) for s in sets_of(texts)})
    stars = jaccard._signed(docs, 3, 90, 100, 5).groupBy("range").applyInArrow(jaccard._range_stars, "a long, b long").distinct()
    # A link in its slice, and one for each of the 40 slices' roots in each of the 32 ranges at most.
    assert stars.count() <= members + 40 * 32
    got = jaccard.join(docs).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got) == [500, 5000]


def test_links_inside_a_block_stay_below_its_members():
    rng = random.Random(5)
    texts = family(rng, [f"v{i}" for i in range(300)], 900, 1)
    table = pa.table({"key": pa.array(range(900), pa.int64()), "root": pa.array([0] * 900, pa.int64()), "text": texts})
    out = jaccard._links_in_block(3, 90, 100)(table)
    assert out.num_rows <= 899
    sets = sets_of(texts)
    pairs = [(i, j) for i in range(900) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert components_of(zip(out["a"].to_pylist(), out["b"].to_pylist()), range(900)) == components_of(pairs, range(900))
