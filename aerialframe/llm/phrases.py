"""Collocations: count tries of shards, cut by ranges of hashed prefixes and merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_batches, quoted, salted, small_batches, texts
from .jaccard import mixed

#: Positions of words in one trie; bytes of text, a part of whose trie is a range of prefixes.
TRIE_WORDS, RANGE_BYTES = 1 << 20, 8 << 20
#: Ranges that a trie is cut into at once.
FAN = 256
#: Pieces end at these, as do words.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_SIGNS = bytes.maketrans(_STOPS + b"\t", b"." * len(_STOPS) + b" ")
#: The language of rows without one.
UNKNOWN = "und"


def tokens(text: str) -> list[bytes]:
    """The words of a text, ASCII letters in lower case, with a dot, which no word holds, where a piece ends."""
    return text.encode().lower().translate(_SIGNS).replace(b".", b" . ").split()


class Trie:
    """Counts of runs of three words, or of what a piece has left, sorted by their words: the leaves of a trie of depth three.

    The count of a phrase is the sum of the leaves that begin with it. Words are numbered from 1 in byte order, 0 is the end of a piece. ``single`` has the
    count of each word, as a part of a trie may hold a word without all of its runs.
    """

    def __init__(self, words: list[bytes], runs: np.ndarray, counts: np.ndarray, single: np.ndarray):
        self.words, self.runs, self.counts, self.single = words, runs, counts, single

    @classmethod
    def of(cls, number: dict[bytes, int], ids: np.ndarray) -> Trie:
        """``number`` has the dot as 0; ``ids`` ends with a 0."""
        words = sorted(w for w in number if w != b".")
        rank = np.zeros(len(number), np.int64)
        rank[[number[w] for w in words]] = np.arange(1, len(words) + 1)
        a = np.concatenate([rank[ids], [0, 0]])
        first, second, third = a[:-2], a[1:-1], a[2:]
        third = np.where(second > 0, third, 0)
        some = first > 0
        return cls(words, *_summed(first[some], second[some], third[some], np.ones(some.sum(), np.int64), len(words) + 1), np.bincount(first, minlength=len(words) + 1)[1:])

    @classmethod
    def joined(cls, pieces: list[bytes]) -> Trie:
        """Serialised tries as one. Each is sorted by its words, so that end to end they are sorted runs, which the stable sort merges."""
        parts = [unpacked(p) for p in pieces]
        words = sorted(set().union(*(p[0] for p in parts)))
        number = {w: k for k, w in enumerate(words, 1)}
        ranks = [np.concatenate([[0], np.fromiter(map(number.__getitem__, p[0]), np.int64, len(p[0]))]) for p in parts]
        runs = [np.concatenate([r[p[1][k]] for r, p in zip(ranks, parts, strict=True)]) for k in range(3)]
        single = np.zeros(len(words) + 1, np.int64)
        for r, p in zip(ranks, parts, strict=True):
            single[r[p[1][4]]] += p[1][5]  # a piece holds a word once
        return cls(words, *_summed(*runs, np.concatenate([p[1][3] for p in parts]), len(words) + 1), single[1:])

    def ranges(self, n: int) -> Iterator[tuple[int, bytes]]:
        """The trie cut by ``n`` ranges of the hash of the first two words of a run, each serialised with the words that it uses.

        Counts of single words are kept in the range of their own hash.
        """
        hashes = np.concatenate([[0], np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))]).astype(np.uint64)
        place = lambda h: ((mixed(h) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        counted = np.flatnonzero(self.single)
        of_run = place(mixed(hashes[self.runs[0]]) + hashes[self.runs[1]])
        of_word = place(hashes[1:][counted])
        by_run, by_word = (np.argsort(x, kind="stable") for x in (of_run, of_word))
        held = np.union1d(of_run, of_word)  # of many ranges a small trie meets few
        cuts = [[np.searchsorted(x[o], held, side) for side in ("left", "right")] for x, o in ((of_run, by_run), (of_word, by_word))]
        new = np.zeros(len(self.words) + 1, np.uint32)
        for i, k in enumerate(held.tolist()):
            run, word = (o[a[i] : b[i]] for o, (a, b) in zip((by_run, by_word), cuts, strict=True))
            word = counted[word]
            used = np.unique(np.concatenate([self.runs[:, run].ravel(), word + 1]))
            used = used[used > 0]
            new[used] = np.arange(1, len(used) + 1)
            yield k, packed([self.words[i - 1] for i in used.tolist()], [*new[self.runs[:, run]], self.counts[run], new[word + 1], self.single[word]])

    def phrases(self, least: int) -> list[tuple]:
        """(w1, w2, w3, f, f of the first two) with f >= ``least``, by a walk up from the leaves, where the trie holds all runs of a pair."""
        first, second, third = self.runs
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])[: len(first)])
        pair = np.add.reduceat(self.counts, new) if len(new) else self.counts
        of_leaf = np.repeat(pair, np.diff(np.append(new, len(first))))
        name = lambda k: self.words[k - 1].decode()
        out = [(name(k + 1), None, None, int(self.single[k]), None) for k in np.flatnonzero(self.single >= least).tolist()]
        for k, n in zip(new.tolist(), pair.tolist(), strict=True):
            if n >= least and second[k]:
                out.append((name(first[k]), name(second[k]), None, n, None))
        for k in np.flatnonzero((third > 0) & (self.counts >= least)).tolist():
            out.append((name(first[k]), name(second[k]), name(third[k]), int(self.counts[k]), int(of_leaf[k])))
        return out


def _summed(first: np.ndarray, second: np.ndarray, third: np.ndarray, counts: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs (3 x n), sorted, and the sums of their counts. Pairs are numbered first, as three words may pass 64 bits."""
    pairs, at = np.unique(first * wide + second, return_inverse=True)
    key = at * wide + third
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    key, counts = key[new], np.add.reduceat(counts, new) if len(new) else counts
    return np.stack([pairs[key // wide] // wide, pairs[key // wide] % wide, key % wide]), counts


def packed(words: list[bytes], columns: list[np.ndarray]) -> bytes:
    """Words and columns of numbers, the bytes of the numbers by their place, compressed."""
    text = b"\n".join(words)
    sizes = np.array([len(words), len(text), *map(len, columns)], np.int64)
    kinds = [np.dtype(np.uint64 if k in (3, 5) else np.uint32) for k in range(len(columns))]
    planes = [np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(len(c), kind.itemsize).T).tobytes() for c, kind in zip(columns, kinds, strict=True)]
    return zstandard.ZstdCompressor(1).compress(b"".join([sizes.tobytes(), text, *planes]))


def unpacked(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, text, *sizes = np.frombuffer(data, np.int64, 8).tolist()
    at, columns = 64 + text, []
    for k, size in enumerate(sizes):
        kind = np.dtype(np.uint64 if k in (3, 5) else np.uint32)
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        columns.append(np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64))
        at += size * kind.itemsize
    return data[64 : 64 + text].split(b"\n") if n else [], columns


COUNTS = "lang string, w1 string, w2 string, w3 string, f long, front long"


def phrase_counts(df: DataFrame, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, w1, w2, w3, f, front): phrases of one to three words that occur ``least`` times or more in a language, all their occurrences within pieces.

    ``front`` is the count of the first two words of three. A row without words holds the number of words in a part of the language. Each task
    keeps a trie for each language of TRIE_WORDS words at most (or one document), and gives it in ranges of prefixes; the ranges number as many as
    the text has RANGE_BYTES, so that none outgrows a task, and a language is spread over all of them.

    A trie is cut into FAN ranges at most at once, so that pieces stay pieces: where more are needed, pieces of a range, FAN of them together, are merged
    into tries again, which are cut further.
    """
    rows = df.select(F.coalesce(quoted(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    wanted, levels = 1 + total // RANGE_BYTES, 1
    while FAN**levels < wanted:
        levels += 1
    n = wanted if levels == 1 else next(k for k in range(2, FAN + 1) if k**levels >= wanted)
    piece = "lang string, range long, piece binary"

    def cut_up(name: str, trie: Trie, ranges: int) -> Iterator[pa.RecordBatch]:
        for k, data in trie.ranges(ranges):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([data], pa.binary())], ["lang", "range", "piece"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (number, ids) in held.items():
                yield from cut_up(name, Trie.of(number, np.concatenate(ids)), n)

        for b in small_batches(batches):
            for name, t in zip(column(b, "lang").to_pylist(), texts(b, "t"), strict=True):
                found = tokens(t)
                if size and size + len(found) > TRIE_WORDS:
                    yield from flush()
                    held, size = {}, 0
                number, ids = held.setdefault(name, ({b".": 0}, []))
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in (*found, b".")), np.int64, len(found) + 1))
                size += len(found)
        yield from flush()

    def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[bytes]]]:
        """Pieces that lie together by their first ``keys`` columns; the piece is the last."""
        now, pieces = None, []
        for b in small_batches(batches):
            for *key, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(key[:keys]) != now:
                    if pieces:
                        yield now, pieces
                    now, pieces = tuple(key[:keys]), []
                pieces.append(data)
        if pieces:
            yield now, pieces

    def finer(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (name, *_), pieces in grouped(batches, 3):
                yield from cut_up(name, Trie.joined(pieces), ranges)

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in COUNTS.split(", ")], [pa.string()] * 4 + [pa.int64()] * 2
        for (name, _), pieces in grouped(batches, 2):
            trie = Trie.joined(pieces)
            found = [(None, None, None, int(trie.single.sum()), None), *trie.phrases(least)]
            columns = [[name] * len(found), *(list(c) for c in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    pieces = map_batches(rows, build, piece)
    for level in range(1, levels):
        # of as many pieces as a trie was cut into one trie of about that size is made
        parts = 1 + total // (8 * TRIE_WORDS * n)
        dealt = pieces.select("lang", "range", F.pmod(F.xxhash64("piece"), F.lit(parts)).alias("part"), "piece").repartition("lang", "range", "part")
        pieces = map_batches(dealt.sortWithinPartitions("lang", "range", "part"), finer(n ** (level + 1)), piece)
    return map_batches(pieces.repartition("lang", "range").sortWithinPartitions("lang", "range"), merge, COUNTS)


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    digits = lambda x, n: x.cast(f"decimal({n},0)")
    return F.call_function("div", digits(F.lit(1_000_000), 7) * digits(a, 15) * digits(a, 15), digits(left, 18) * digits(right, 18))


def collocations(df: DataFrame, least: int = 10, percent: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of two and three words of each language (null: UNKNOWN).

    A candidate is a phrase that occurs ``least`` times or more within pieces of text. Cut after its first k words it has the score
    floor(1000000 a^2 / (l r)) from the counts of itself and both parts; the lowest cut counts, of equal ones the shortest front. A phrase of two words that
    a candidate of three holds is dropped if that has ``percent`` of its count or more. Ranks go by score, count and phrase in byte order.

    Null and empty texts hold no words; repeated rows count each time; only ``lang`` and ``text`` are read, so other columns may have any name; an
    empty table gives an empty one. Counts are exact up to 10^15. Front parts come from the walk up the trie, other parts by joins, salted as a few words stand in many phrases.
    """
    counts = cut(phrase_counts(df, least, lang, text))
    sizes = counts.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    one = counts.where("w1 is not null and w2 is null").select("lang", "w1", "f")
    two = counts.where("w2 is not null and w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    three = counts.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("f").alias("a"), "front")
    word = lambda key, f: one.select("lang", F.col("w1").alias(key), F.col("f").alias(f))
    inside = three.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    inside = inside.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    short = two.join(inside, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    short = salted(salted(short, word("w1", "l"), ["lang", "w1"], "w2"), word("w2", "r"), ["lang", "w2"], "w1")
    short = short.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", scored(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    # suffix links: the last two words of three, and the last
    long = salted(three, two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("back")), ["lang", "w2", "w3"], "w1")
    long = salted(salted(long, word("w1", "f1"), ["lang", "w1"], "w3"), word("w3", "f3"), ["lang", "w3"], "w1")
    cuts = [F.struct(scored(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "back"), ("front", "f3")), 1)]
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(*cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = short.unionByName(long).withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
