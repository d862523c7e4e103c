import pytest
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from aerialframe.llm import licenses, queries


def plain(text):
    """Words, and the places of the base phrases, by the definition."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def ours(text):
    joined = licenses.words_of(text)
    at = [(n, label) for phrase, label in licenses.BASE for n in licenses.places(joined, phrase.encode())]
    starts = [n for n, _ in at]
    return joined.count(b" ") + 1 if joined else 0, len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["cc", "CC", "by", " ", "-", "general", "public", "license", "all", "rights", "reserved", "é", "\n", "x", "__"]), max_size=30))
def test_base_places(parts):
    assert ours("".join(parts)) == plain("".join(parts))
    assert ours(" ".join(parts)) == plain(" ".join(parts))


def test_query_against_the_definition(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op10_license_rules(spark, d).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def labels(text):
    return [d[2].label for d in licenses.detect(licenses.words_of(text).decode())]


def test_rules():
    assert len(licenses.rules()) > 200
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("SPDX-License-Identifier: MIT") == ["mit"]
    assert labels("Released under the MIT License. All rights reserved.") == ["mit", "reserved"]
    assert labels("She will submit the license form by noon") == []


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "cc by " * 50_000, 5), (None, "x", 5)], "doc_id long, text string, score int")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (rows[1].n_words, rows[1].labels, rows[1].score, rows[1].first_word) == (0, "", 0.0, None) and rows[2].n_words == 0
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].last_word) == (100_000, 50_000, 0, 99_998)
    assert licenses.scan(df.where("false")).collect() == []


def samples(pattern):
    """Two texts that a pattern matches: each choice its first way or its last, each repetition at its least or, if short, at its most."""
    from re import _constants as c
    from re import _parser as p

    def walk(tree, last):
        out = ""
        for op, arg in tree:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, value = arg[-1 if last else 0]
                out += "x" if kind is c.NEGATE else chr(value if kind is c.LITERAL else value[0]) if kind is not c.CATEGORY else "x"
            elif op is c.NOT_LITERAL:
                out += "x"
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                low, high, sub = arg
                out += walk(sub, last) * (high if last and high <= 3 else max(low, 1 if op is c.MIN_REPEAT else low))
            elif op is c.SUBPATTERN:
                out += walk(arg[3], last)
            elif op is c.BRANCH:
                out += walk(arg[1][-1 if last else 0], last)
            else:
                raise AssertionError(op)
        return out

    return [" ".join(walk(p.parse(pattern), last).split()) for last in (False, True)]


def test_each_rule_fires_and_lets_near_misses_be():
    """A rule's keyword stands in what it matches, so the prefilter never hides it; a text with one word changed or cut is no match of it."""
    assert len(licenses.FAMILIES.strip().splitlines()) * 2 + len(licenses.SINGLE.strip().splitlines()) > 250
    for rule, compiled in licenses.rules():
        for text in samples(rule.pattern):
            assert compiled.search(text) and rule.keyword in text, (rule, text)
            assert any(d[2].label for d in licenses.detect(f"some words {text} and more")), rule
            assert not compiled.fullmatch(f"q{text}") and not compiled.search(f"q{text}q".replace(" ", "")), rule
            assert not compiled.search(" ".join(f"{w}qq" for w in text.split())), rule


@pytest.mark.parametrize(
    "text, label",
    [
        ("Simplified BSD License", "bsd-2-clause"), ('BSD 3-Clause "New" or "Revised" License', "bsd-3-clause"), ("GNU GPL version 3", "gpl-3.0"), ("Apache-2.0", "apache-2.0"),
        ("LGPL-2.1-or-later", "lgpl-2.1"), ("GPLv2", "gpl-2.0"), ("under the GPLv3", "gpl-3.0"), ("LGPLv3", "lgpl-3.0"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"),
        ("Do What The Fuck You Want To Public License", "wtfpl"), ("Neither the name of " + "the very long holder " * 10 + "may be used to endorse or promote products", "bsd-3-clause"),
        ("they won 1-0", ""), ("an apache helicopter", ""), ("mit dem Hund", ""), ("the gplv", ""),
    ],
)
def test_common_spellings(text, label):
    assert ",".join(sorted({d[2].label for d in licenses.detect(licenses.words_of(text).decode())})) == label


def plain_labels(joined):
    """All rules on the whole text, then every detection that lies in one before it by priority, length, place and label is dropped."""
    found = [(m.start(), m.end(), r) for r, p in licenses.rules() for m in p.finditer(joined)]
    kept = []
    for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    left = 1.0
    for rule in {k[2] for k in kept}:
        left *= 1 - rule.weight
    return {k[2].label for k in kept}, left


def test_query_against_all_rules(spark):
    """Labels and score of every document of the table, and of some made of several notices, without prefilter or shortcuts."""
    from aerialframe.llm import queries

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op10_license_rules(spark, d).collect()
    several = [f"{samples(a.pattern)[0]} {samples(b.pattern)[1]} word" for (a, _), (b, _) in zip(licenses.rules()[::7], licenses.rules()[::-7], strict=False)]
    made = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(several)], "doc_id long, text string")
    rows += licenses.scan(made).drop("text").collect()
    texts = {r.doc_id: r.text for r in docs + made.collect()}
    for r in rows:
        labels, left = plain_labels(licenses.words_of(texts[r.doc_id] or "").decode())
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels | base))
        assert abs(r.score - (0.5 if base and left == 1 else 1 - left)) < 1e-6
