import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerialframe.llm import pii, queries


def plain(text):
    """The base patterns as written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PARTS = ["a@b.c", "@", ".", "a", "b-", "1", "255", "256", "1.2.3.4", "4539 1488 0343 6467", "4785380592391139", "0", "+1 (555) 010-9999", "+", "-", " ", "(", "é", "٣", "\n", "%"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_spans(parts):
    assert pii.base_spans("".join(parts)) == plain("".join(parts))


def test_query_against_the_patterns(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_disclosure_spans(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        spans, got = plain(r.text or ""), rows[r.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got.spans.startswith(text)
        assert [got[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]


def corpus():
    noise = [f"word{i % 17} other{i % 5} thing{i % 3}" for i in range(200)]
    rows = [(i, f"{noise[i]} call Zorblatt at zz@mail.org now") for i in range(6)]  # the name stands by this address only
    rows += [(i, f"{noise[i]} call me at u{i}@mail.org now") for i in range(6, 30)]
    return rows + [(i, noise[i]) for i in range(30, 200)] + [(300, "Zorblatt again"), (301, None), (302, "")]


def test_terms_that_disclose(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert [(r.term, r.level) for r in pii.disclosing_terms(df).collect()] == [("zorblatt", 1)]
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert spans[300] == spans[301] == spans[302] == []  # a document without entities is left alone
    assert ("term", *(corpus()[0][1].find("Zorblatt") + k for k in (0, 8))) in spans[0]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[300] == "Zorblatt again" and clean[301] is None and "[email]" in clean[7] and clean[100] == dict(corpus())[100]
    assert clean[0] == corpus()[0][1].replace("Zorblatt", "at").replace("zz@mail.org", "[email]")  # "at" is frequent and near


def test_a_term_seen_nowhere_else_is_removed(spark):
    df = spark.createDataFrame([r for r in corpus() if r[0] != 300], "doc_id long, text string").withColumnRenamed("doc_id", "spans")
    assert [(r.term, r.level) for r in pii.disclosing_terms(df).collect()] == [("zorblatt", 2)]
    clean = {r.spans: r.text for r in pii.sanitise(df).collect()}  # the caller's column of that name stays
    assert set(clean) == {r[0] for r in corpus() if r[0] != 300} and "Zorblatt" not in " ".join(filter(None, clean.values()))


def test_clashing_names(spark):
    rows = [(text, *[f"{n}{i}" for n in ("key", "marks", "bound", "_uid", "at")]) for i, text in corpus()]
    df = spark.createDataFrame(rows, "text string, key string, marks string, BOUND string, _uid string, at string")
    got = pii.find(df).collect()
    plain_ = {r.text: r.spans for r in pii.find(df.select("text")).collect()}
    assert all(r.spans == plain_[r.text] for r in got) and sorted(r.key for r in got) == sorted(r[1] for r in rows)
    assert pii.sanitise(df).columns == df.columns


def plain_marks(docs):
    """{(text, term): level} by the definition, over lists."""
    docs = [t or "" for t in docs]
    total, n_entity, n_term, n_both, texts, near = len(docs), Counter(), Counter(), Counter(), {}, {}
    info = {}
    for t in set(docs):
        spans = pii.base_spans(t)
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in spans)
        words = [m for m in re.finditer(r"\w+", t) if not inside(m) and not m[0].isdigit()]
        close = set()
        for _, a, _ in spans:
            k = sum(m.start() < a for m in words)
            close |= {m[0].lower() for m in words[max(0, k - pii.CONTEXT) : k + pii.CONTEXT]}
        info[t] = {pii.entity(k, t[a:b]) for k, a, b in spans}, {m[0].lower() for m in words}, close
    for t in docs:
        entities, words, _ = info[t]
        n_entity.update(entities)
        n_term.update(words)
        n_both.update((e, w) for e in entities for w in words)
    for t, (entities, words, close) in info.items():
        for e in entities:
            for w in words:
                texts[e, w] = texts.get((e, w), 0) + 1
                near[e, w] = near.get((e, w), False) or w in close
    out = {}
    for t, (entities, words, _) in info.items():
        for e in entities:
            ic = -math.log2(n_entity[e] / total)
            for w in words if ic > 0 else ():
                n, k, z = n_term[w], n_both[e, w], pii.Z
                low = (k / n + z * z / 2 / n - z * math.sqrt(k / n * (1 - k / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)
                share = 1 + math.log2(low) / ic
                if share >= pii.GENERALISE and (texts[e, w] > 1 or near[e, w]):
                    out[t, w] = max(out.get((t, w), 0), 2 if share >= pii.REMOVE else 1)
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_marks_against_the_definition(spark, sf):
    """Every pair of entity and word, on the real table, with some texts repeated and some entities shared."""
    docs = [r.text for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]
    docs += [t for t in docs if pii.base_spans(t)][:3] * 2
    docs += [f"{t} mail boss@firm.example" for t in docs[:40]]
    got = {}
    for r in pii.find(spark.createDataFrame([(t,) for t in docs], "text string").repartition(7)).collect():
        for s in r.spans:
            if s.kind == pii.TERM:
                got[r.text, r.text[s.start : s.end].lower()] = s.level
                assert s.general is None or s.general.lower() != r.text[s.start : s.end].lower()
    want = plain_marks(docs)
    assert got == want and len(got) > 20


def test_replacements_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    """However few counts are broadcast, the same word stands for a term; a dot in a column's name changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for size in (1, 300, 1 << 16):
        monkeypatch.setattr(pii, "FREQUENT", size)
        got.append(sorted(map(tuple, pii.sanitise(docs.toDF("a.id", "a.b"), "a.b").collect())))
    assert got[0] == got[1] == got[2]
    generals = [s.general for r in pii.find(docs).collect() for s in r.spans if s.kind == pii.TERM and s.level == 1]
    assert sum(g is not None for g in generals) > 100


def test_registered_query_marks_terms_of_documents_with_entities_only(spark):
    rows = queries.op2_disclosure_spans(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_term for r in rows) > 0 and all(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows if r.n_term)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "1" * 300_000), (2, "a" * 300_000 + "@"), (3, "1-" * 100_000), (1, "1" * 300_000)], "doc_id long, text string")
    assert all(r.spans == [] for r in pii.find(df).collect())
    assert pii.find(df.where("false")).collect() == []
