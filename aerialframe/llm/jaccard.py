"""Exact similarity join of word shingle sets: shards in which similar sets must meet, and signature trees within a shard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, quoted, remove, salted, small_batches, texts, with_columns, write_table
from .graph import components
from .simhash import overlaps, unite

#: Sizes of a family of sets lie within this ratio (plus what similar sets may be larger).
FAMILY_RATIO = 1.5
#: Divisions of the shingles tried for a set that leaves too many parts empty, before all such sets of a family meet in one shard.
ATTEMPTS = 4
#: Shingles of the sets of one side of a local join; children of a node of a tree; bits of a signature for each shingle, at least.
BLOCK_SHINGLES, FANOUT, SIGNATURE_BITS = 1 << 21, 8, 4
#: Bytes of signatures that are compared at once; words whose hashes are kept.
CHUNK_BYTES, CACHED_WORDS = 1 << 24, 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """XXH64 of words, kept until there are CACHED_WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str, words: int, cache: Hashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes: of each run of ``words`` words, or of all words if they are fewer; none for no word."""
    tokens = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(one) - words + 1)
    found = np.full(n, min(words, len(one)), np.uint64)
    for k in range(min(words, len(one))):
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n])
    return np.unique(found)


@lru_cache(maxsize=8)
def families(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, largest size, parts, parts that may be empty) of the families for sets of up to ``most`` shingles.

    Of two similar sets the smaller one belongs to the family of its size, and the larger one, at most 100 / percent times as large, too.
    Together they hold at most D shingles that are not in both, so of D + 1 + spare parts of all shingles, spare + 1 at least hold the same.
    """
    low = [1]
    while low[-1] <= most:
        low.append(max(low[-1] + 1, int(low[-1] * FAMILY_RATIO)))
    low = np.array(low, np.int64)
    top = (low[1:] - 1) * 100 // percent
    differ = (100 - percent) * (low[1:] - 1 + top) // (100 + percent)
    spare = 1 + differ // 30
    return low[:-1], top, differ + 1 + spare, spare


def shard_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """For each set the keys of its shards. Two sets whose Jaccard similarity is ``percent`` or more have a key in common, unless they are equal.

    A family divides all shingles into parts by a hash; a key is a hash of what a set holds of a part. A set with more empty parts than its
    family spares is divided again in another way; two such sets meet there, and those that fail each time all meet.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    low, top, parts, spare = families(percent, int(sizes.max(initial=1)))
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    starts = np.cumsum(sizes) - sizes
    member = (sizes[:, None] >= low) & (sizes[:, None] <= top) & (parts - spare > 1)  # at one part sets must be equal
    owner, family = np.nonzero(member)
    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for attempt in range(ATTEMPTS):
        if not len(owner):
            break
        n = sizes[owner]
        slot = np.repeat(np.arange(len(owner)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[owner], n)
        value = mixed(every[at] + np.uint64((attempt + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        part = (value >> np.uint64(32)).astype(np.int64) * parts[family][slot] >> 32
        place = slot << 32 | part
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        held = np.add.reduceat(mixed(value[order]), first)
        slot, part = place[first] >> 32, place[first] & 0xFFFFFFFF
        label = (family[slot].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(4)) + np.uint64(attempt)
        keys.append(mixed(held + mixed(label)))
        owners.append(owner[slot])
        empty = parts[family] - np.bincount(slot, minlength=len(owner))
        owner, family = owner[empty > spare[family]], family[empty > spare[family]]
    if len(owner):
        keys.append(mixed(family.astype(np.uint64) + np.uint64(1 << 60)))
        owners.append(owner)
    owner, key = (np.concatenate([*x, np.empty(0, t)]).astype(t) for x, t in ((owners, np.int64), (keys, np.uint64)))
    order = np.argsort(owner, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])


class SignatureTree:
    """Sets below nodes that hold their token bitmaps, combined by OR, and the range of their sizes; level 0 are the sets.

    Sets lie in the order of their smallest hash and size, so that similar ones tend to share their nodes.
    """

    def __init__(self, sets: list[np.ndarray], width: int):
        self.place = np.array(sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]))), np.int64)
        self.sets = [sets[i] for i in self.place]
        size = np.array([len(s) for s in self.sets], np.int64)
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for row, s in zip(bits, self.sets, strict=True):
            spread = np.zeros(width, np.uint8)
            spread[s & np.uint64(width - 1)] = 1
            row[:] = np.packbits(spread)
        bits = bits.view(np.uint64)
        # shingles of a set that share a bit with others of it
        spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def raised(self, height: int) -> SignatureTree:
        """This tree with its root repeated, up to ``height`` levels."""
        self.levels += [self.levels[-1]] * (height - len(self.levels))
        return self

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``node``, child) for nodes of a level above 0."""
        below, here = len(self.levels[level - 1][0]), len(self.levels[level][0])
        fan = FANOUT if below > here else 1
        n = np.minimum(fan, below - node * fan)
        at = np.repeat(np.arange(len(node)), n)
        return at, node[at] * fan + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def linked(one: list[np.ndarray], other: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of ``one``, then ``other``) and, for each, one of its component that it differs from: the components of similar sets.

    All pairs of ``one`` if there is no ``other``, else all pairs across. Two trees are walked at once: a pair of nodes is left if the largest
    overlap that their bitmaps and sizes allow is too small, or if all sets below them are already connected.
    """
    width = 64
    while width < SIGNATURE_BITS * max(len(s) for s in (*one, *(other or []))):
        width *= 2
    x = SignatureTree(one, width)
    y = x if other is None else SignatureTree(other, width)
    height = max(len(x.levels), len(y.levels))
    x.raised(height), y.raised(height)
    label = np.arange(len(one) + (0 if other is None else len(other)))  # by place in the trees
    base = 0 if other is None else len(one)
    chunk = max(64, CHUNK_BYTES // (width // 8))
    shown: dict[tuple[int, int], np.ndarray] = {}

    def common(tree: SignatureTree, level: int, at: int) -> np.ndarray:
        """The label that all sets below each node have, or -1."""
        if (found := shown.get((level, at))) is None:
            if level == 0:
                found = label[at : at + len(tree.sets)]
            elif len(tree.levels[level][0]) == len(tree.levels[level - 1][0]):
                found = common(tree, level - 1, at)
            else:
                below = common(tree, level - 1, at)
                starts = np.arange(0, len(below), FANOUT)
                least = np.minimum.reduceat(below, starts)
                found = np.where(least == np.maximum.reduceat(below, starts), least, -1)
            shown[level, at] = found
        return found

    stack = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        one_a, one_b = common(x, level, 0)[a], common(y, level, base)[b]
        keep = (one_a != one_b) | (one_a < 0)
        if other is None:
            keep &= (a < b) if level == 0 else (a <= b)
        (bits_a, low_a, high_a, spare_a), (bits_b, low_b, high_b, spare_b) = x.levels[level], y.levels[level]
        keep &= (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a])
        a, b = a[keep], b[keep]
        most = np.bitwise_count(bits_a[a] & bits_b[b]).sum(1, dtype=np.int64) + np.minimum(spare_a[a], spare_b[b])
        most = np.minimum(most, np.minimum(high_a[a], high_b[b]))
        keep = (100 + percent) * most >= percent * (low_a[a] + low_b[b])
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level:
            at, up = x.children(level, a)
            again, down = y.children(level, b[at])
            up = up[again]
            stack += [(level - 1, up[i : i + chunk], down[i : i + chunk]) for i in range(0, len(up), chunk)][::-1]
            continue
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for i, group in zip(a[np.flatnonzero(np.diff(a, prepend=-1))].tolist(), np.split(b, np.flatnonzero(np.diff(a)) + 1), strict=True):
            may = group[label[base + group] != label[i]]
            if not len(may):
                continue
            mine, theirs = x.sets[i], [y.sets[j] for j in may]
            both = shared(mine, theirs)
            size = np.array([len(s) for s in theirs], np.int64)
            hit = may[(100 + percent) * both >= percent * (size + len(mine))]
            if len(hit):
                unite(label, np.full(len(hit), i), base + hit)
                shown.clear()
    place = x.place if other is None else np.concatenate([x.place, len(one) + y.place])
    moved = label != np.arange(len(label))
    return place[moved], place[label[moved]]


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes of a set are in each of the others."""
    sizes = np.array([len(x) for x in others], np.int64)
    near = overlaps(one, others)  # s = both / (one + size - both)
    return np.rint(near * (len(one) + sizes) / (1 + near)).astype(np.int64)


def solved(words: int, percent: int):
    """Links (a, b) of shards whose rows (hub, i, j, block, node, t) come sorted by hub, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, now = Hashes(), None
        node: tuple[list[int], list[int]] = ([], [])
        sets: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def links() -> pa.RecordBatch:
            a = b = np.empty(0, np.int64)
            same = now is not None and now[1] == now[2]
            if now is not None and len(sets[0]) > same and (same or sets[1]):
                left, right = linked(sets[0], None if same else sets[1], percent)
                every = np.array([*node[0], *node[1]], np.int64)
                a, b = every[left], every[right]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in small_batches(batches):
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for hub, i, j, block, n, t in zip(*columns, strict=True):
                if (hub, i, j) != now:
                    if len(node[0]) + len(node[1]) > 1:
                        yield links()
                    now, node, sets = (hub, i, j), ([], []), ([], [])
                side = int(block != i)
                node[side].append(n)
                sets[side].append(shingle_set(t, words, cache))
        yield links()

    return run


def similar_classes(df: DataFrame, words: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``.

    A row's set are the distinct shingles of ``words`` words, or all its words as one if they are fewer, ASCII letters in lower case. Two rows
    are linked if their sets have a Jaccard similarity of ``percent`` / 100 or more, 67 at least; ``component_id`` is the smallest key reachable over links, the
    row's own included (null only where all those are null). Null, empty and wordless texts have an empty set and are linked with nothing,
    so their component is their own key. Repeated rows, and texts with equal sets, are of one class, which is compared once. Only ``key``
    and ``text`` are read, so other columns may have any name; an empty table gives an empty one.

    Sets that are similar share a shard (see ``shard_keys``), found by counting keys. The shards of which a set is the least one are put
    together (its hub), large ones are cut into blocks, and each pair of blocks is walked with signature trees. No pair is missed; a shard
    gives no more links than rows.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must lie between 67 and 100")
    spark = df.sparkSession
    given = df.select(quoted(key).alias("key"), quoted(text).alias("t"), F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("tid"))
    cache = Hashes()

    def describe(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sets = [shingle_set(t, words, cache) for t in texts(batch, "t")]
        node = [int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))) if len(s) else None for s in sets]
        keys = pa.array([k.view(np.int64) for k in shard_keys(sets, percent)], pa.list_(pa.int64()))
        return {"n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(node, pa.int64()), "keys": keys}

    rows, path = write_table(with_columns(given, "n long, node long, keys array<long>", describe).drop("t"), "shingles")
    # equal sets have equal keys, so copies need no merging first: a shard counts if two nodes meet there
    met = rows.where("node is not null").select("node", F.explode("keys").alias("shard"))
    hubs = met.groupBy("shard").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    members = cut(salted(met, hubs, ["shard"], "node").select("hub", "node").distinct())
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("tid").alias("tid"), F.first("n").alias("n"))
    wanted = cut(members.select("node").distinct().join(nodes, "node"))
    # one text of each node; copies of a text meet in their own tasks first
    contents = given.select("tid", "t").groupBy("tid").agg(F.first("t").alias("t")).join(wanted.select("tid", "node"), "tid").select("node", "t")
    placed = members.join(wanted.select("node", "n"), "node")
    blocks = placed.groupBy("hub").agg((F.floor((F.sum("n") - 1) / BLOCK_SHINGLES) + 1).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")
    cells = salted(members, blocks, ["hub"], "node").select("hub", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("hub", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node")
    spread = cells.join(contents, "node").select("hub", "i", "j", "block", "node", "t")
    spread = spread.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "node")
    found = components(map_batches(spread, solved(words, percent), "a long, b long"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("first")).join(found, "node", "left")
    classes = classes.select("node", "first", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("first").alias("least"))
    classes = classes.join(least, "label").select("node", "least")
    out = salted(rows.drop("keys", "tid"), classes, ["node"], "key", "left")
    out = cut(out.select(quoted("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id")))
    remove(spark, path)
    return out
