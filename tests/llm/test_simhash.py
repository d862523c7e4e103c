import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aerialframe.llm import graph, simhash


def plain_fingerprint(text, words=3):
    """By the definition, one bit at a time."""
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    tokens = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    if not tokens:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + words]).encode(), 42) for i in range(max(1, len(tokens) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=2):
    """{value: smallest value reachable} by comparing all pairs."""
    values = sorted(set(values))
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


TEXTS = ["", None, "  \t\n", "one", "One", "one two", "A b c", "a b C", "a b c d", "é È", "a\x0bb\x0cc", "a\x1cb c", "x " * 3000, "X " * 3000]


def test_fingerprints_follow_the_definition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fp for r in simhash.fingerprints(df).collect()}
    assert {k: v % (1 << 64) for k, v in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_majority_over_many_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_forest_finds_all_pairs(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 62, 5, dtype=np.uint64)
    value = np.unique(np.concatenate([[b ^ np.uint64(sum(1 << int(k) for k in r.choice(62, 3, replace=False))) for _ in range(60)] for b in base]))
    group = r.integers(0, 3, len(value))
    got = {(int(a), int(b)) for q, n in simhash.Forest(group, value).near(radius, block=64) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(len(value)) for j in range(i) if group[i] == group[j] and (int(value[i]) ^ int(value[j])).bit_count() <= radius}
    assert got == want


def test_crowded_shards_lose_no_link(spark, monkeypatch):
    """A dense ball of values forces several rounds of cutting; all components must stay those of the pairwise comparison."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    r = np.random.default_rng(3)
    values = {0, 1, (1 << 63) | 5}
    for centre in (0x0123456789ABCDEF, 0x8000000000000001):
        for _ in range(60):
            v = centre
            for b in r.choice(64, r.integers(0, 4), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.label for r in graph.components(simhash.links(df, 2)).collect()}
    parts = {}
    for v, label in plain_components(values).items():
        parts.setdefault(label, set()).add(v - (1 << 64) if v >> 63 else v)
    want = {v: min(p) for p in parts.values() if len(p) > 1 for v in p}
    assert found == want


def test_query_against_all_pairs(spark):
    from aerialframe.llm import queries

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    prints = {k: plain_fingerprint(t) for k, t in docs.items()}
    label = plain_components(prints.values())
    least = {}
    for k, v in prints.items():
        least[label[v]] = min(k, least.get(label[v], k))
    got = queries.op1_simhash_bktree(spark, d).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{v:016x}", least[label[v]]) for k, v in prints.items()}
    assert len(got) == len(docs)


def test_edges_of_the_input(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, None, None), (7, "", "fingerprint"), (None, "q r s", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(df.where(F.lit(False))).collect() == []


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def similar_sets(texts_):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts_]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0


def all_pairs(texts_):
    """The groups of texts of a comparison of all pairs, as sets of numbers."""
    alike, label = similar_sets(texts_), list(range(len(texts_)))
    for i in range(len(texts_)):
        for j in range(i):
            if label[i] != label[j] and alike(i, j) >= 0.8:
                label = [label[j] if v == label[i] else v for v in label]
    return {frozenset(i for i, v in enumerate(label) if v == g) for g in set(label)}


def test_chains_and_templates_lose_no_link(spark):
    """A chain whose ends have little in common, and texts around one passage that are alike in pairs only."""
    r = np.random.default_rng(5)
    word = lambda: f"w{r.integers(1 << 40)}"
    chain = [[word() for _ in range(400)]]
    for k in range(30):
        chain.append(chain[-1][:])
        chain[-1][12 * k : 12 * k + 12] = [word() for _ in range(12)]
    passage = [word() for _ in range(340)]
    template = []
    for _ in range(40):
        common, own = [word() for _ in range(22)], [[word() for _ in range(38)] for _ in range(2)]
        template += [passage + common + o for o in own]
    values = [" ".join(t) for t in chain + template] + ["", " ", "a b", "A  b"]
    want = all_pairs(values)
    assert sorted(map(len, want))[-1] == 31 and sum(len(g) == 2 for g in want) >= 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string").repartition(5)
    kept = {x.doc_id for x in simhash.first_of_groups(df).collect()}
    assert kept == {min(g) for g in want}


def test_blocks_of_a_bucket(spark, monkeypatch):
    """What a root leaves over is compared in blocks, however few rows a block may hold."""
    monkeypatch.setattr(simhash, "OPEN_ROWS", 2)
    monkeypatch.setattr(simhash, "MEMBER_ROWS", 3)
    monkeypatch.setattr(simhash, "HUB_ROWS", 2)
    texts_ = [" ".join(f"{g}_{k}" if k else f"own{i}" for k in range(40)) for i in range(24) for g in [i % 5]]
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "node long, t string")
    members = nodes.selectExpr("0 as place", "0L as value", "node", "0L as root")
    pairs = members.selectExpr("root as hub", "node").where("node > 0")
    found = {(r.a, r.b) for r in simhash.similar(pairs, nodes, 5, 0.8).collect()}
    assert found == {(0, i) for i in range(5, 24, 5)}
    labels = graph.components(spark.createDataFrame(sorted(found), "a long, b long"))
    more = simhash.left_over(members, labels, nodes, 5, 0.8)
    final = {r.node: r.label for r in graph.components(more.union(spark.createDataFrame(sorted(found), "a long, b long"))).collect()}
    assert final == {i: i % 5 for i in range(24)}


def near_balls(count, seed):
    """Values that lie densely around a few centres, with their highest bits set too."""
    r = np.random.default_rng(seed)
    values = {0, 1, (1 << 63) | 5}
    for centre in (0x0123456789ABCDEF, 0x8000000000000001):
        for _ in range(count):
            values.add(centre ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)))
    return sorted(values)


@pytest.mark.parametrize("shard_rows", [8, 512])
def test_direct_links_are_all_pairs(spark, monkeypatch, shard_rows):
    """A value keeps each partner within the radius, not one of them, whether shards are cut or not."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = near_balls(60, 4)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, 2, gather=50, direct=True).collect()]
    want = {(max(signed(v), signed(w)), min(signed(v), signed(w))) for v in values for w in values if v < w and (v ^ w).bit_count() <= 2}
    assert sorted(got) == sorted(want) and len(want) > len(values)


@pytest.mark.parametrize("rows", [(64, 256), (2, 3)])
def test_all_texts_of_near_values_are_compared(spark, monkeypatch, rows):
    """Values with many partners and many unlike texts, and no other bucket in which texts could meet."""
    r = np.random.default_rng(6)
    monkeypatch.setattr(simhash, "OPEN_ROWS", rows[0])
    monkeypatch.setattr(simhash, "MEMBER_ROWS", rows[1])
    values = near_balls(9, 7)
    texts_, prints = [], []
    for i in range(150):
        group = int(r.integers(0, 25))
        words = [f"own{i}"] + [f"g{group}_{k}" for k in range(120)]
        for k in range(i % 3):  # texts of which two words differ are like those of which none does, not like each other
            words[int(r.integers(10, 50)) + 55 * k] = f"own{i}"
        texts_.append(" ".join(words))
        prints.append(values[int(r.integers(0, len(values)))])
    given = {int(simhash.shingle_hashes(t, 5)[0]): p for t, p in zip(texts_, prints, strict=True)}
    monkeypatch.setattr(simhash, "majority", lambda h: given[int(h[0])])
    monkeypatch.setattr(simhash, "sampled", lambda h: h[0] + np.arange(16, dtype=np.uint64))  # shared by none
    alike, label = similar_sets(texts_), list(range(len(texts_)))
    for i in range(len(texts_)):
        for j in range(i):
            if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 2 and alike(i, j) >= 0.8:
                label = [label[j] if v == label[i] else v for v in label]
    want = {min(i for i, v in enumerate(label) if v == g) for g in set(label)}
    assert 25 < len(want) < 140
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(5)
    assert {x.doc_id for x in simhash.first_of_groups(df).collect()} == want


def test_callers_columns_stay(spark):
    rows = [(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x2", "y2", "z2"), (3, "q", "x3", "y3", "z3"), (None, None, "x4", "y4", "z4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string, NODE string, label string")
    got = sorted((tuple(r) for r in simhash.first_of_groups(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3]], key=str)
    assert [r.FP for r in simhash.fingerprints(df.withColumnRenamed("NODE", "FP")).select(F.col("fp").alias("FP")).limit(1).collect()][0] is not None


def test_names_with_dots(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, text), (1, text + " end"), (None, text), (2, "other words")], "`a.b` long, `T.x` string")
    assert sorted(r[0] for r in simhash.first_of_groups(df, key="a.b", text="T.x").collect()) == [1, 2]
    assert sorted(map(tuple, simhash.near_duplicates(df.where("`a.b` is not null"), key="a.b", text="T.x").select("`a.b`").collect())) == [(1,), (2,), (3,)]
