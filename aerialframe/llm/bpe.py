"""Byte-level BPE: pre-tokens from a scan over transition functions, then cached pair merging."""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, with_columns

# Classes of code points. The last three hold for an apostrophe that begins a contraction of one or two letters if a
# token begins there, and for the gap between two texts.
LETTER, NUMBER, OTHER, SPACE, BLANK, SPACE_LAST, BLANK_LAST, SHORT, LONG, GAP = range(10)
#: White space other than categories Zs, Zl and Zp.
CONTROL_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
#: Letters that may follow an apostrophe.
SHORT_ENDS, LONG_ENDS = ("s", "t", "m", "d"), ("re", "ve", "ll")
# Ranges of letters and numbers of Unicode 16.0 that Python's tables of 15.1 do not have.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# States after a code point: which run it belongs to, or how many letters of a contraction are still to come.
IN_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LEAD, WANT_1, WANT_2, CUT = range(9)
STATES = 9


@functools.cache
def _class_table() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110001, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        out[c] = BLANK if category in ("Zs", "Zl", "Zp") else kinds.get(category[0], OTHER)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(CONTROL_SPACES)] = BLANK
    out[0x20], out[0x110000] = SPACE, GAP
    return out


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of class ``kind``, and whether a token begins with it.

    Of a white-space run followed by something else the last member stands apart (classes ..._LAST): a space then leads the token that follows.
    """
    if kind == GAP:
        return IN_START, True
    if state == WANT_2:
        return WANT_1, False
    if state == WANT_1:
        return CUT, False
    if kind == SPACE_LAST:
        return LEAD, True
    if kind == BLANK_LAST:
        return CUT, True
    if kind in (SPACE, BLANK):
        return IN_WHITE, state != IN_WHITE
    if kind in (SHORT, LONG) and state not in (IN_OTHERS, LEAD):
        return (WANT_1 if kind == SHORT else WANT_2), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHERS)
    return run, state not in (run, LEAD)


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions closed under composition.

    Returns the number of each class's function, the table of products (first, then second), the functions as rows of
    states, and whether a token begins at (state before, class).
    """
    single = [tuple(_step(s, k)[0] for s in range(STATES)) for k in range(GAP + 1)]
    numbers: dict[tuple[int, ...], int] = {}
    for f in [tuple(range(STATES)), *single]:
        numbers.setdefault(f, len(numbers))
    todo = list(numbers)
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in numbers:
                numbers[h] = len(numbers)
                todo.append(h)
    functions = np.array(list(numbers), np.uint8)
    product = np.array([[numbers[tuple(int(x) for x in g[f])] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(s, k)[1] for k in range(GAP + 1)] for s in range(STATES)])
    return np.array([numbers[f] for f in single], np.uint16), product, functions, begins


def _scan(f: np.ndarray, product: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix products of ``f``: side by side within blocks, then over the blocks' totals, then both together."""
    n = len(f)
    if n <= 1:
        return f.copy()
    rows = -(-n // width)
    padded = np.zeros(rows * width, f.dtype)  # function 0 is the identity
    padded[:n] = f
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = product[grid[i - 1], grid[i]]
    if rows > 1:
        before = np.concatenate([[0], _scan(grid[-1], product, width)[:-1]]).astype(f.dtype)
        grid = product[before[None, :], grid]
    return grid.T.reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens begin in an array of code points, in which 0x110000 parts one text from the next."""
    kind = _class_table()[points]
    n = len(kind)
    following = np.append(kind[1:], GAP)
    white = (kind == SPACE) | (kind == BLANK)
    last = white & (following != SPACE) & (following != BLANK) & (following != GAP)
    kind[last & (kind == SPACE)] = SPACE_LAST
    kind[last & (kind == BLANK)] = BLANK_LAST
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        kind[quotes[np.isin(one, [ord(c) for c in SHORT_ENDS]) & (quotes + 1 < n)]] = SHORT
        pair = functools.reduce(np.logical_or, [(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDS])
        kind[quotes[pair & (quotes + 2 < n)]] = LONG
    number, product, functions, begins = _monoid()
    after = functions[_scan(number[kind], product), IN_START]
    before = np.concatenate([[IN_START], after[:-1]]).astype(np.uint8)
    return np.flatnonzero(begins[before, kind])


class Vocabulary:
    """Merge ranks and the ids of pre-tokens seen so far, as little-endian unsigned 32-bit integers."""

    #: Longer pre-tokens are merged anew each time; beyond so many pre-tokens the cache starts again.
    CACHED_BYTES, CACHED = 64, 150_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        data = text.encode()
        found = np.array(merge(data, self.ranks), "<u4").tobytes()
        if len(data) <= self.CACHED_BYTES:
            if len(self.cache) >= self.CACHED:
                self.cache.clear()
            self.cache[text] = found
        return found


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbours of lowest rank (the leftmost of equals) until none can be joined."""
    if (whole := ranks.get(data)) is not None:
        return [whole]
    return _merge_short(data, ranks) if len(data) <= 100 else _merge_long(data, ranks)


def _merge_short(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    never, get = 1 << 60, ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [get(data[i : i + 2], never) for i in range(len(data) - 1)]
    while pairs and (least := min(pairs)) != never:
        i = pairs.index(least)
        joined = parts[i] + parts[i + 1]
        parts[i] = joined
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, never)
    return [ranks[p] for p in parts]


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for runs of any length."""
    n = len(data)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = nxt[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(joined):
            continue
        parts[i], parts[j] = joined, None
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := ranks.get(joined + parts[k])) is not None:
                heapq.heappush(heap, (r, i, joined + parts[k]))
        if (h := prv[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + joined))
    return [ranks[p] for p in parts if p is not None]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_batch(values: list[str], vocab: Vocabulary) -> list[bytes]:
    gap = np.array([0x110000], np.uint32)
    points = [np.frombuffer(v.encode("utf-32-le"), np.uint32) for v in values]
    starts = boundaries(np.concatenate([x for p in points for x in (p, gap)] or [gap]))
    out, at = [], 0
    cache, piece = vocab.cache, vocab.piece
    # a boundary stands at each text's start and at the gap after it
    edges = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in points)]))
    for i, v in enumerate(values):
        cuts = (starts[edges[i] : edges[i + 1]] - at).tolist()
        pieces = [v[a:b] for a, b in itertools.pairwise(cuts)]
        out.append(b"".join([found if (found := cache.get(p)) is not None else piece(p) for p in pieces]))
        at += len(v) + 1
    return out


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``n_tokens`` (long), ``token_ids`` and ``token_ends``; with ``decoded`` also what ``decode`` makes of the ids, in the same pass.

    ``token_ids`` are little-endian unsigned 32-bit integers; ``token_ends`` are 64-bit ones, the byte of the UTF-8 text at
    which each token ends, so any span of tokens maps back to the text. A null text is empty and has no tokens; texts of any length are
    encoded whole. Columns of these names in ``df`` are replaced, in any case. Repeated rows each get the same ids; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        vocab = vocabulary(vocabulary_path)
        ids = encode_batch(texts(batch, text), vocab)
        ends = [np.cumsum(vocab.lengths[np.frombuffer(x, "<u4")]).astype("<i8").tobytes() for x in ids]
        out = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary()), "token_ends": pa.array(ends, pa.binary())}
        return out | ({"decoded": _decoded(ids, vocab)} if decoded else {})

    return with_columns(df, "n_tokens long, token_ids binary, token_ends binary" + (", decoded binary" if decoded else ""), run)


def _decoded(ids: list[bytes | None], vocab: Vocabulary) -> pa.Array:
    return pa.array([b"".join([vocab.tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in ids], pa.binary())


def decode(df: DataFrame, vocabulary_path: str, token_ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the tokens in order; null ids give empty bytes, repeated rows the same.

    A column ``decoded`` of ``df`` is replaced, in any case; others stay. An empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"decoded": _decoded(batch.column(batch.schema.get_field_index(token_ids)).to_pylist(), vocabulary(vocabulary_path))}

    return with_columns(df, "decoded binary", run)
