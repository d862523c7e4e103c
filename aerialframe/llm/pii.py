"""Personal data by pattern, and terms that disclose it by their co-occurrence in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, free_name, quoted, small_batches, texts, with_columns

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Possessive forms of the base patterns. A match of digits never begins within a run of digits, hence the look-behind.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
#: What a text must hold for any base pattern to match; read by Java and Python alike.
NEEDED = r"@|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){12}"
_NEEDED = re.compile(NEEDED)
#: Words on either side of an entity that count as near it; the share of an entity's information from which a term is
#: generalised, and from which it is removed; normal quantile of the confidence bound.
CONTEXT, GENERALISE, REMOVE, Z = 8, 0.75, 0.85, 1.96
#: Occurrences of a term that must have a word near them for that word to stand for it.
SUBSUMES = 0.8
#: Terms whose counts are broadcast to save their joins, the most frequent ones; texts that may be broadcast because each holds over that part of all rows.
FREQUENT, HOT = 1 << 16, 256
#: Terms counted in one task before they are handed on.
HELD_TERMS = 200_000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    if not _NEEDED.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> int:
    """An entity by 64 bits that don't show it: letters and digits in lower case count."""
    plain = "".join(c for c in value.lower() if c.isalnum() or c in "@.")
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Words with a letter that lie outside all spans, in lower case, with their places."""
    taken = sorted((s, e) for _, s, e in spans)
    out, k, reach = [], 0, 0
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach and not m[0].isdigit():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def near_terms(found: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> set[str]:
    """Those of ``found`` that stand within CONTEXT of them before or after an entity."""
    starts = np.array([s for _, s, _ in found], np.int64)
    at = np.searchsorted(starts, [s for _, s, _ in spans]).tolist()
    return {t for a in at for t, _, _ in found[max(0, a - CONTEXT) : a + CONTEXT]}


def _number(term: str) -> int:
    """64 bits that stand for a term."""
    n = xxhash.xxh64_intdigest(term.encode(), 7)
    return n - (1 << 64) if n >> 63 else n


def _read(docs: DataFrame, text: str) -> DataFrame:
    """One pass over all texts. A row is a text that holds entities (key, n copies, entities, terms, near: for each term if it stands
    near an entity), or a term with the number n of documents that hold it, or, with neither, n documents read."""
    keyed = docs.select(F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("key"), quoted(text).alias("text"))
    schema = "key long, entities array<long>, terms array<long>, near array<boolean>, term long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        held: dict[int, list] = {}
        size = read = 0

        def rows() -> pa.RecordBatch:
            blank, n = [None] * (len(seen) + 1), list(held.values())
            return pa.RecordBatch.from_pydict({
                "key": pa.array([*held, *blank], pa.int64()),
                "entities": pa.array([*(h[1] for h in n), *blank], pa.list_(pa.int64())),
                "terms": pa.array([*(h[2] for h in n), *blank], pa.list_(pa.int64())),
                "near": pa.array([*(h[3] for h in n), *blank], pa.list_(pa.bool_())),
                "term": pa.array([*[None] * len(n), *map(_number, seen), None], pa.int64()),
                "n": pa.array([*(h[0] for h in n), *seen.values(), read], pa.int64()),
            })

        for b in small_batches(batches):
            read += b.num_rows
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                spans = base_spans(t)
                if not spans:
                    seen.update({w.lower() for w in WORD.findall(t) if not w.isdigit()})
                    continue
                found = terms(t, spans)
                words = {w for w, _, _ in found}
                seen.update(words)
                if key in held:
                    held[key][0] += 1
                    continue
                close, order = near_terms(found, spans), sorted(words)
                held[key] = [1, sorted({entity(k, t[a:b]) for k, a, b in spans}), [_number(w) for w in order], [w in close for w in order]]
                size += len(order)
            if len(seen) + size >= HELD_TERMS:
                yield rows()
                seen.clear()
                held.clear()
                size = read = 0
        yield rows()

    return keyed.mapInArrow(run, schema)


def _share(n_both, n_term, n_entity, total: int):
    """The share of an entity's information that a term gives: 1 + log p(e | t) / IC(e), with the lower Wilson bound of p(e | t)."""
    p, z2 = n_both / n_term, Z * Z
    low = (p + z2 / (2 * n_term) - Z * F.sqrt(p * (1 - p) / n_term + z2 / (4 * n_term * n_term))) / (1 + z2 / n_term)
    return 1 + F.log2(low) / -F.log2(n_entity / F.lit(float(total)))


def _most(n_entity, total: int):
    """The number of documents beyond which no term can disclose an entity of n_entity documents: p(e | t) <= n(e) / n(t)."""
    return F.pow(n_entity.cast("double"), F.lit(GENERALISE)) * F.lit(float(total) ** (1 - GENERALISE))


def disclosures(docs: DataFrame, text: str = "text") -> DataFrame:
    """What is to be marked, (key, n, bound, marks, safe).

    ``key`` is xxhash64 of a text that holds entities, ``n`` the documents with that text, ``marks`` its disclosing terms as (term, level),
    ``bound`` the number of documents that a term must pass to be sure to disclose none of the text's entities, and ``safe`` the text's terms that
    do, as (term, n_term), where one of its marks is to be generalised (else null). Documents are counted:
    n(e) holding entity e, n(t) holding term t outside of entities, n(e, t) holding both. PMI(e; t) / IC(e) = 1 + log p(e | t) / IC(e) is
    the share of e's information that t gives; p(e | t) is taken at its lower confidence bound, so that few documents prove little and
    no count is cut off. Pairs of one text only count if the term stands near an entity there. Level 2 is to be removed, 1 to be generalised.

    Entities that stand in the same texts are one class, so a list of addresses is no more work than one address. Frequent terms meet
    their counts by a broadcast of fixed size and all others by a join; keys that many rows share are salted. Null and empty texts count
    as documents without terms; of an empty table nothing is marked. Repeated rows count as often as they stand.
    """
    rows = cut(_read(docs, text))
    total = rows.where("key is null and term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = cut(rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n_term")))
    frequent = cut(counts.orderBy(F.desc("n_term"), "term").limit(FREQUENT))
    held = rows.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("entities", "terms", "near")])
    held = cut(held)
    salt = lambda n: F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(n)).cast("int").alias("salt")
    salts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")

    each = held.select("key", "n", F.explode("entities").alias("entity"), salt(8))
    same_texts = [F.bit_xor(F.xxhash64(F.lit(i), "key")) for i in (1, 2)]
    stats = each.groupBy("entity").agg(F.sum("n").alias("n_entity"), *[c.alias(f"x{i}") for i, c in enumerate(same_texts)])
    stats = stats.select("entity", "n_entity", F.xxhash64("n_entity", "x0", "x1").alias("class"), salts(8))
    classes = cut(each.join(stats, ["entity", "salt"]).select("key", "class", "n_entity").distinct())

    most = classes.groupBy("key").agg(_most(F.max("n_entity"), total).alias("bound"))
    zipped = F.explode(F.arrays_zip("terms", "near"))
    words = held.join(most, "key").select("key", "n", "bound", zipped.alias("t")).select("key", "n", "bound", F.col("t.terms").alias("term"), F.col("t.near").alias("near"))

    def counted(rows: DataFrame, wanted: str) -> DataFrame:
        """``rows`` (key, term and more) with ``n_term``, those that are ``wanted``. A frequent term has its count from the broadcast and goes anywhere."""
        rows = rows.join(F.broadcast(frequent), "term", "left").where(f"n_term is null or {wanted}")
        rows = rows.withColumn("at", F.when(F.col("n_term").isNull(), F.col("term")).otherwise(F.xxhash64("key", "term")))
        rows = rows.join(counts.select(F.col("term").alias("at"), F.col("n_term").alias("n_rare")), "at", "left")
        return rows.withColumn("n_term", F.coalesce("n_term", "n_rare")).drop("at", "n_rare").where(wanted)

    pairs = counted(words, "n_term <= bound").join(classes, "key").where(F.col("n_term") <= _most(F.col("n_entity"), total))
    pairs = cut(pairs.select("key", "n", "bound", "term", "near", "n_term", "class", "n_entity"))

    sums = pairs.groupBy("class", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.max("near").alias("near"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")
    )
    told = sums.where((F.col("n_entity") < total) & ((F.col("texts") > 1) | F.col("near"))).withColumn("share", _share(F.col("n_both"), F.col("n_term"), F.col("n_entity"), total))
    told = told.where(F.col("share") >= GENERALISE).select("class", "term", F.when(F.col("share") >= REMOVE, 2).otherwise(1).alias("level"), salts(8))
    marked = pairs.withColumn("salt", salt(8)).join(told, ["class", "term", "salt"]).groupBy("key", "term").agg(F.max("level").alias("level"), F.first("n").alias("n"), F.first("bound").alias("bound"))
    marks = cut(marked.groupBy("key").agg(F.first("n").alias("n"), F.first("bound").alias("bound"), F.collect_list(F.struct("term", "level")).alias("marks")))
    # what may stand for a generalised term is looked for among all terms of its text
    some = marks.where(F.exists("marks", lambda m: m.level == 1)).select("key", "bound").join(held, "key").select("key", "bound", F.explode("terms").alias("term"))
    safe = counted(some, "n_term > bound").groupBy("key").agg(F.collect_list(F.struct("term", "n_term")).alias("safe"))
    return cut(marks.join(safe, "key", "left").withColumn("hot", F.col("n") * HOT > total))


SPAN = "struct<kind:string,start:bigint,end:bigint,level:int,general:string>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("general", pa.string())]))


def general_word(words: list[str], places: list[int], safe: dict[str, int]) -> str | None:
    """The rarest of the words that subsume a term: near at least SUBSUMES of its ``places``, and one of ``safe`` (with the number of documents that hold
    it), so that it discloses nothing; None if no word does."""
    near = Counter(w for i in places for w in set(words[max(0, i - CONTEXT) : i + CONTEXT + 1]))
    found = [(safe[w], w) for w, k in near.items() if k >= SUBSUMES * len(places) and w in safe]
    return min(found, default=(0, None))[1]


def find(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``spans``: an array of (kind, start, end, level, general) in code points, ends exclusive.

    Base kinds come in their order, then ``term`` spans of terms that disclose an entity of the same document (see ``disclosures``), by start;
    a document without entities has none. ``level`` is 2 for what is to be removed, 1 for what is to be replaced by ``general``, a more
    general word, where there is one. Base spans never depend on the corpus. A null text has no spans; texts are handled whole, and
    repeated rows each get the same result. A column ``spans`` of ``df`` is replaced, all others stay; ``text`` is dropped unless
    ``keep_text``. Only texts that may hold an entity are shuffled and seen by Python. An empty table gives an empty result.
    """
    out = _found(df, text, False)
    return out if keep_text else out.drop(text)


def _found(df: DataFrame, text: str, sanitised: bool) -> DataFrame:
    """``df`` with ``spans``, and with sanitised texts if asked for, in one pass over the texts that may hold an entity."""
    marks = disclosures(df, text)
    rows = df.drop("spans")
    key, given = free_name(rows, "key"), free_name(rows, "marks")
    bound, more, at = (free_name(rows.withColumn(given, F.lit(0)), n) for n in ("bound", "more", "at"))
    may = F.coalesce(quoted(text).rlike(NEEDED), F.lit(False))
    clean = rows.where(~may).withColumn("spans", F.array().cast(f"array<{SPAN}>"))
    held = rows.where(may).withColumn(key, F.xxhash64(quoted(text)))
    told = F.struct("marks", "safe")
    hot = marks.where("hot").select(F.col("key").alias(key), told.alias(given))  # each in over a HOT-th of all rows, so no more than HOT of them
    cold = marks.where("not hot").select(F.col("key").alias(at), told.alias(more))
    held = held.join(F.broadcast(hot), key, "left")
    spread = F.xxhash64(key, F.monotonically_increasing_id())
    held = held.withColumn(at, F.when(F.col(given).isNull(), F.col(key)).otherwise(spread)).join(cold, at, "left")
    held = held.withColumn(given, F.coalesce(given, more)).drop(key, more, at)

    def mark(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for t, m in zip(texts(batch, text), column(batch, given).to_pylist(), strict=True):
            spans = base_spans(t)
            row = [{"kind": k, "start": a, "end": b, "level": 2, "general": None} for k, a, b in spans]
            if m:
                level = {x["term"]: x["level"] for x in m["marks"]}
                found = terms(t, spans)
                words = [w for w, _, _ in found]
                numbers = {w: _number(w) for w in set(words)}
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    if numbers[w] in level:
                        places.setdefault(w, []).append(i)
                count = {x["term"]: x["n_term"] for x in m["safe"] or ()}
                safe = {w: count[n] for w, n in numbers.items() if n in count}
                instead = {w: general_word(words, p, safe) for w, p in places.items() if level[numbers[w]] == 1}
                hits = sorted(i for p in places.values() for i in p)
                row += [{"kind": TERM, "start": found[i][1], "end": found[i][2], "level": level[numbers[words[i]]], "general": instead.get(words[i])} for i in hits]
            out.append(row)
        made = {"spans": pa.array(out, _SPAN)}
        return made | ({text: pa.array(map(redacted, column(batch, text).to_pylist(), out), pa.string())} if sanitised else {})

    new = f"spans array<{SPAN}>" + (f", `{text}` string" if sanitised else "")
    return clean.union(with_columns(held, new, mark).drop(given).select(*map(quoted, clean.columns)))


def disclosing_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """(term, level): the terms that ``find`` marks anywhere, with their highest level."""
    each = find(df.select(quoted(text).alias("text"))).select("text", F.explode("spans").alias("s")).where(F.col("s.kind") == TERM)
    return each.groupBy(F.lower(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("term")).agg(F.max("s.level").alias("level"))


def redacted(text: str | None, spans: list[dict] | None) -> str | None:
    """A text without its spans. Of overlapping spans the first stands for all."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            new = f"[{s['kind']}]" if s["kind"] != TERM else "" if s["level"] == 2 else s["general"] or f"[{TERM}]"
            parts += [text[at : s["start"]], new]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (with ``spans``) whose ``text`` is sanitised: base spans become their kind in brackets, a disclosing term is left out
    (level 2) or becomes its more general word, ``[term]`` if it has none (level 1).

    A null text and a null ``spans`` leave the text as it is; repeated rows each get the same text; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {text: pa.array(map(redacted, column(batch, text).to_pylist(), column(batch, "spans").to_pylist()), pa.string())}

    return with_columns(df, f"`{text}` string", run)


def sanitise(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with texts as ``redact`` makes them of what ``find`` finds; its other columns stay as they are, one named ``spans`` too. Rows and
    their number stay the same; an empty table gives an empty one."""
    mine = free_name(df, "spans")
    if mine == "spans":
        return _found(df, text, True).select(*map(quoted, df.columns))
    done = _found(df.withColumnRenamed("spans", mine), text, True).drop("spans").withColumnRenamed(mine, "spans")
    return done.select(*map(quoted, df.columns))
