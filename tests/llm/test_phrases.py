import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerialframe.llm import phrases


def plain(rows, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in count.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["New", "York", "city", "É", "日本", "a'b", "\x01", "z" * 50]
    rows = []
    for _ in range(300):
        w = [r.choice(vocabulary[: r.choice([3, 10, 38])]) for _ in range(r.randrange(40))]
        if r.random() < 0.5:
            w[r.randrange(len(w) + 1) :] = ["NEW", "york"] + ["city"] * (r.random() < 0.7)
        rows.append((r.choice(["en", "en", "en", "de", None, ""]), "".join(x + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", "\x0b", "?!"]) for x in w)))
    return [*rows, ("en", None), (None, ""), ("fr", " . \t"), ("xx", "one two " * 12), ("xx", "one two " * 12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_lists(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "TRIE_WORDS", 1 << (21 if seed == 1 else 6))
    monkeypatch.setattr(phrases, "RANGE_BYTES", [8 << 20, 1000, 100][seed - 1])
    rows = made(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(df).collect()))
    assert got == plain(rows) and {g[0] for g in got} >= {"en", "xx"}
    assert sorted(map(tuple, phrases.collocations(df, 3, 80, 7).collect())) == plain(rows, 3, 80, 7)


def test_ranges_in_steps(spark, monkeypatch):
    """More ranges than a trie is cut into at once: pieces are merged and cut again, three times over."""
    monkeypatch.setattr(phrases, "TRIE_WORDS", 200)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 500)
    monkeypatch.setattr(phrases, "FAN", 4)
    rows = made(4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert sum(len(t or "") for _, t in rows) // 500 > 4**2
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain(rows)


def test_products_beyond_a_long(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 5), (9 * 10**14, 10**15 - 1, 10**15 - 1)], "a long, l long, r long")
    got = [x[0] for x in df.select(phrases.scored(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * a * a // (b * c) for a, b, c in [(big, big + 1, big + 5), (9 * 10**14, 10**15 - 1, 10**15 - 1)]]


def test_pieces_round_trip():
    words = [b"a", "é".encode(), b"z" * 1000]
    columns = [np.array(x, np.int64) for x in ([1, 2, 3], [0, 1, 2], [0, 0, 3], [5, 1 << 40, 7], [1], [9])]
    again, back = phrases.unpacked(phrases.packed(words, columns))
    assert again == words and all((a == b).all() for a, b in zip(columns, back, strict=True))
    number = {b".": 0, b"b": 1, b"a": 2}
    ids = np.array([1, 2, 1, 2, 0, 2, 0])
    cut = {k: phrases.unpacked(p) for k, p in phrases.Trie.of(number, ids).ranges(7)}
    total = Counter()
    for w, (first, second, third, counts, single, n) in cut.values():
        name = [b"", *w]
        total.update({(name[i], name[j], name[k]): c for i, j, k, c in zip(first, second, third, counts, strict=True)})
        total.update({(name[i],): c for i, c in zip(single, n, strict=True)})
    assert total == {(b"b", b"a", b"b"): 1, (b"a", b"b", b"a"): 1, (b"b", b"a", b""): 1, (b"a", b"", b""): 2, (b"a",): 3, (b"b",): 2}


def test_odd_tables(spark):
    schema = "lang string, text string, rank int, PHRASE string, a int"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None, 1, "x", 2)], schema)).collect() == []
    long = "x y " * 200_000
    rows = [("en", long), ("en", "x y"), ("en", "x y")]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], schema)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain(rows)
    dotted = spark.createDataFrame(rows, "`l.l` string, `t.t` string")
    assert sorted(map(tuple, phrases.collocations(dotted, lang="l.l", text="t.t").collect())) == plain(rows)
