import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from aerialframe.llm import mixing, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_groups(rows):
    """Smallest id of each component of texts with a Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b]:
                x, y = sets[a], sets[b]
                if (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8:
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = {k: new if v == old else v for k, v in label.items()}
    return set(label.values())


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_groups([(r.doc_id, r.text) for r in docs.collect()]))


def test_stages_handle_edges(spark):
    rows = [(i, f"the cat number {i} and the dog are here with us today, they said {i * 7}", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (None, "the dog sat", None, None, 3), (5, rows[5][1], "en", "x", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, "")
            assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
            assert out.count() <= 3 * table.count()


def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, d).collect()
    assert 0.5 * len(docs) < len(rows) <= 3 * len(docs) and {r.doc_id for r in rows} <= set(docs)
    same = sum(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest() for r in rows)
    assert same > 0.5 * len(rows)  # all but those that held personal data, and those that a pass that is not full has cut


def test_mixture_words_meet_targets(spark):
    """Words of each source against its target, where one document holds a third of a source, and every row against a replay of the draw."""
    r = random.Random(1)
    size = {}
    for k in range(6):
        for i in range(40):
            size[100 * k + i] = 20 * 39 if i == 7 else 1 + r.randrange(79)
    texts = {i: " " + "\n\t".join(f"w{i}\u00a0x_{j}" for j in range(n)) + " " for i, n in size.items()}
    docs = spark.createDataFrame([(i, t, "en", f"s{i // 100}", len(t)) for i, t in texts.items()], COLUMNS)
    rows = corpus_pipeline.mixture(spark, docs.repartition(5), "").collect()
    sizes = [sum(n for i, n in size.items() if i // 100 == k) for k in range(6)]
    spec = mixing.plan([(f"s{k}", n) for k, n in enumerate(sizes)], corpus_pipeline.MIX_BLOCK)
    order = {x.doc_id: x.hash for x in docs.select("doc_id", F.xxhash64("doc_id", "source", "lang", "text").alias("hash")).collect()}
    want, block = [], corpus_pipeline.MIX_BLOCK
    for k in range(6):
        mine = sorted((i for i in size if i // 100 == k), key=order.get)
        words = [(i, j) for i in mine for j in range(size[i])]
        for t in range(mixing.PASSES):
            some = np.arange(t * spec.blocks[k], min(spec.slots[k], (t + 1) * spec.blocks[k])) - t * spec.blocks[k]
            drawn = {w for b in mixing.permute(some, spec.blocks[k], k * mixing.PASSES + t).tolist() for w in words[b * block : (b + 1) * block]}
            for i in mine:
                if held := [j for j in range(size[i]) if (i, j) in drawn]:
                    runs = "".join(("\n\t" if n and held[n - 1] == j - 1 else "\n" if n else "") + f"w{i}\u00a0x_{j}" for n, j in enumerate(held))
                    want.append((i, texts[i] if len(held) == size[i] else runs))
    assert sorted((x.doc_id, x.text) for x in rows) == sorted(want)
    words = lambda t: len(re.findall(mixing.WORD, t))
    for k in range(6):
        mine = [x for x in rows if x.source == f"s{k}"]
        assert abs(sum(words(x.text) for x in mine) - spec.targets[k]) <= block
    assert all(x.n_chars == len(x.text) > 0 for x in rows) and any(x.text != texts[x.doc_id] for x in rows)


def test_mixture_is_the_same_however_rows_are_dealt(spark):
    """The same rows, copies among them, in other partitions and in another order give the same mix."""
    rows = [(i % 190, " ".join(f"w{i % 190}_{j}" for j in range(1 + i * 7 % 90)) if i % 190 else None, "en", f"s{i % 3}" if i % 11 else None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, COLUMNS)
    dealt = [docs.repartition(5), docs.orderBy(F.desc("n_chars")).coalesce(1), docs.repartition(3, "text")]
    got = [sorted(corpus_pipeline.mixture(spark, d, "").collect(), key=str) for d in dealt]
    assert got[0] and got[0] == got[1] == got[2]


def test_language_without_labels_and_with_many(spark):
    rows = [(1, "plain words", None, "a", 11), (2, "123 !?", None, "a", 6), (3, None, None, "a", None), (4, "été", None, None, 3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(40)]
    rows = [(100 * k + i, f"{w} " * (10 + i), f"l{k}", "a", 1) for k, w in enumerate(words) for i in range(9)]
    mixed = [(9000 + i, " ".join(words[i : i + 3] * 20), None, "a", 1) for i in range(5)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(rows + mixed, COLUMNS), "").collect()}
    assert {r[0] for r in mixed} <= kept and len(kept) >= 0.99 * len(rows + mixed)


def test_clashing_columns_pass_through(spark):
    """Columns with the names that stages use inside come out as they went in."""
    extra = ["_row", "row", "size", "words", "passes", "key", "spans", "marks", "lang_pred", "score", "fp", "node", "label", "_node"]
    rows = [(i, f"the cat number {i} and the dog w{i * i} are here u{i}@mail.org with v{i * 31} today", "en", f"s{i % 3}", 1, *[f"{n}{i}" for n in extra]) for i in range(40)]
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", `{n}` string" for n in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").collect()
        assert out and all(r[n] == f"{n}{r.doc_id}" for r in out for n in extra), name
