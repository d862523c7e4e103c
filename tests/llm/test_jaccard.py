import random

import numpy as np
import pytest

from aerialframe.llm import jaccard


def plain(rows, words=3, percent=90):
    """All pairs, with sets of words themselves."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (k, _), x in zip(rows, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return sorted(((k, len(s), least.get(x) if s else k) for (k, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def made(seed, copies=40):
    """Texts of many sizes, with copies that change a few words, chains of copies, and a passage that many texts share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for n in (1, 2, 3, 4, 9, 11, 12, 13, 20, 21, 22, 30, 57, 100, 150, 400):
        w = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(copies):
            if n > 20 and r.random() < 0.2:
                w = [r.choice(vocabulary) for _ in range(n)]
                w[: len(passage)] = passage
            kind = r.random()
            if kind < 0.3 and n > 3:
                w = list(w)
                w[r.randrange(len(w))] = r.choice(vocabulary)
            elif kind < 0.5:
                w = [*w, r.choice(vocabulary)]
            elif kind < 0.6 and len(w) > 2:
                w = w[1:]
            out.append(r.choice([" ", "\t", "  \n"]).join(x.upper() if r.random() < 0.1 else x for x in w))
    out += [None, "", " \t\r\n", "\x0b\x0c", "One two", "one TWO", "a b c d", "É é x", "é é x"]
    r.shuffle(out)
    return [(10 * i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1 << (10 if seed == 1 else 21))
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_classes(df).collect()), key=str) == plain(rows)


def test_similar_sets_share_a_key():
    """Pairs at the bound, of every size up to 400, also where few shingles are spread over many parts."""
    r = np.random.default_rng(3)
    for percent in (67, 80, 90, 97):
        sets = []
        for n in [*range(1, 120), 250, 400]:
            one = r.integers(0, 1 << 63, n).astype(np.uint64)
            both = -(-percent * n // 100)
            sets.append([np.unique(one), np.unique(one[:both])])  # a part of it
            low = next(i for i in range(n + 1) if (100 + percent) * i >= 2 * percent * n)
            sets.append([np.unique(one), np.unique(np.concatenate([one[:low], r.integers(0, 1 << 63, n - low).astype(np.uint64)]))])
        flat = [s for pair in sets for s in pair]
        keys = jaccard.shard_keys(flat, percent)
        for k, (a, b) in enumerate(sets):
            assert len(np.intersect1d(a, b)) * (100 + percent) >= percent * (len(a) + len(b))
            assert np.array_equal(a, b) or len(np.intersect1d(keys[2 * k], keys[2 * k + 1]))


def test_divided_again(monkeypatch):
    """Where parts stay empty too often, sets meet by later divisions or all together."""
    monkeypatch.setattr(jaccard, "families", lambda percent, most: (np.array([1]), np.array([10**6]), np.array([64]), np.array([1])))
    keys = jaccard.shard_keys([np.arange(5, dtype=np.uint64), np.arange(100, 105, dtype=np.uint64), np.arange(10**5, dtype=np.uint64)], 90)
    assert len(np.intersect1d(keys[0], keys[1])) == 1 and len(keys[2]) == 64


def test_tree_prunes(monkeypatch):
    """Unlike sets are left at bitmaps: no overlap is counted; groups of copies are compared about once for each copy."""
    counted = []
    real = jaccard.shared
    monkeypatch.setattr(jaccard, "shared", lambda one, others: counted.append(len(others)) or real(one, others))
    r = np.random.default_rng(5)
    unlike = [np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(300)]
    assert len(jaccard.linked(unlike, None, 90)[0]) == 0 and sum(counted) == 0
    base = unlike[0]
    copies = [np.unique(np.concatenate([base[:-3], r.integers(0, 1 << 63, 3).astype(np.uint64)])) for _ in range(500)]
    a, b = jaccard.linked(copies, None, 90)
    assert len(a) == 499 and sum(counted) < 5000
    a, b = jaccard.linked(copies[:200], copies[200:], 90)
    assert len(a) == 499


def test_odd_tables(spark):
    schema = "doc_id long, text string, n long, node string, hub int, t int"
    assert jaccard.similar_classes(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (None, text), (1, text + " end"), (None, None), (7, ""), (8, "")]
    df = spark.createDataFrame([(*x, 1, "a", 2, 3) for x in rows], schema)
    assert sorted(map(tuple, jaccard.similar_classes(df).collect()), key=str) == plain(rows)
    long = " ".join(str(i) for i in range(200_000))
    dotted = spark.createDataFrame([(1, long), (2, long + " x"), (3, "x " * 100_000)], "`a.b` long, `T.x` string")
    got = jaccard.similar_classes(dotted, key="a.b", text="T.x")
    assert got.columns == ["a.b", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == [(1, 199_998, 1), (2, 199_999, 1), (3, 1, 3)]
    with pytest.raises(ValueError, match="percent"):
        jaccard.similar_classes(df, percent=50)
