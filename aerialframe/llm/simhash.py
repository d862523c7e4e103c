"""SimHash fingerprints linked through BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, free_name, quoted, remove, salted, small_batches, texts, with_columns, write_table
from .graph import components

SEED = 42
#: A shard with more fingerprints is cut further, as long as bits remain to cut by.
SHARD_ROWS = 512
#: Rounds of cutting: 64 bits leave 43, 29, 20, 14 open with a radius of 2.
ROUNDS = 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if there are fewer words; none for no word."""
    tokens = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    last = ends[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255 * 256):  # sums of 255 bits fit a byte
        bits = np.unpackbits(hashes[a : a + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        count += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        count += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """``df`` with ``fp``, the 64-bit SimHash of its word shingles as a signed long. A null or wordless text has 0.

    Repeated rows each get the same value; a column ``fp`` of ``df`` is replaced, in any case; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = np.array([majority(shingle_hashes(t, words)) for t in texts(batch, text)], np.uint64)
        return {"fp": pa.array(found.view(np.int64))}

    return with_columns(df, "fp long", run)


class Forest:
    """BK-trees over the values of each group: a child hangs from its parent by their Hamming distance.

    All trees grow level by level at once. An edge is the number 65 * parent + distance, and edges are kept sorted, so
    that those within a range of distances are a slice. Values of a group must differ.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value = value
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        self.root = first[inverse]
        rest = np.flatnonzero(self.root != np.arange(len(value)))
        parent = self.root[rest]
        edges, children = [], []
        while len(rest):
            edge = parent * 65 + np.bitwise_count(value[rest] ^ value[parent])
            found, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(found)
            children.append(rest[first])
            parent, stays = rest[first][inverse], np.ones(len(rest), bool)
            stays[first] = False
            rest, parent = rest[stays], parent[stays]
        edge, child = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (edges, children))
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def near(self, radius: int, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places whose values differ in ``radius`` bits or fewer, in pieces; only edges within the radius are followed."""
        n = len(self.value)
        stack = [(np.arange(a, min(a + block, n)), self.root[a : a + block]) for a in range(0, n, block)]
        while stack:
            q, node = stack.pop()
            d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (q > node)
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            n_next = high - low
            total = int(n_next.sum())
            if not total:
                continue
            at = np.repeat(low - np.cumsum(n_next) + n_next, n_next) + np.arange(total)
            q, node = np.repeat(q, n_next), self.child[at]
            stack += [(q[a : a + block], node[a : a + block]) for a in range(0, total, block)]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the smallest label among them, in place."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label != (up := label[label])).any():
            label[:] = up


def _masks(radius: int, rounds: int) -> list[list[int]]:
    """For each round the bits that are held equal on each path.

    Values that differ in ``radius`` bits agree on one of radius + 1 parts of their bits; the bits left open are cut again
    in the next round.
    """
    paths: list[tuple[list[int], list[int]]] = [([], list(range(64)))]
    out = []
    for _ in range(rounds):
        nxt = []
        for held, left in paths:
            for part in np.array_split(np.array(left), radius + 1):
                nxt.append((held + part.tolist(), [b for b in left if b not in set(part.tolist())]))
        paths = nxt
        out.append([sum(1 << b for b in held) for held, _ in paths])
    return [[m - (1 << 64) if m >> 63 else m for m in masks] for masks in out]


def shards(distinct: DataFrame, radius: int) -> DataFrame:
    """(round, path, key, fp): shards in which any two values within ``radius`` meet at least once.

    A shard holds the values that agree on the bits of its path. One with over SHARD_ROWS values is replaced by those of
    the next round, on which its values meet too, so nothing is lost and no shard grows with a group of near copies:
    in the last round 14 open bits hold 2^14 values at most.
    """
    masks = _masks(radius, ROUNDS)
    rows = distinct.select("fp", F.explode(F.array([F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks[0])])).alias("s")).select("fp", "s.*")
    done = None
    for k in range(ROUNDS):
        level = rows.select(F.lit(k).alias("round"), "path", "key", "fp")
        if k < ROUNDS - 1:
            crowded = cut(rows.groupBy("path", "key").count().where(F.col("count") > SHARD_ROWS).select("path", "key"))
            last = crowded.isEmpty()
            if not last:
                level = level.join(crowded, ["path", "key"], "left_anti").select("round", "path", "key", "fp")
        else:
            last = True
        done = level if done is None else done.union(level)
        if last:
            return done
        below = F.explode(F.sequence(F.col("path") * (radius + 1), F.col("path") * (radius + 1) + radius)).alias("path")
        held = F.element_at(F.array([F.lit(m) for m in masks[k + 1]]), F.col("path") + 1)
        rows = cut(rows.join(crowded, ["path", "key"], "left_semi").select("fp", below).withColumn("key", F.col("fp").bitwiseAND(held)))
    raise AssertionError


def links(distinct: DataFrame, radius: int, gather: int = 50_000, direct: bool = False) -> DataFrame:
    """(a, b): for each value of ``distinct`` (fp) linked to another in a shard, the first value it is joined to there.

    Trees are built for many shards at a time from rows sorted by shard; within a shard linked values are joined to one of them, so
    a shard of n values gives n - 1 rows at most. With ``direct`` every pair of values within the radius instead, once and with a > b.
    A lone value has no row.
    """
    spread = shards(distinct, radius).repartition("round", "path", "key").sortWithinPartitions("round", "path", "key", "fp")

    def solve(round_: np.ndarray, path: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (path[1:] != path[:-1]) | (round_[1:] != round_[:-1])])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        group, fp = group[many], fp[many]
        own = np.arange(len(fp))
        label = own.copy()
        if len(fp):
            for a, b in Forest(group, fp.view(np.uint64)).near(radius):
                if direct:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
                else:
                    unite(label, a, b)
        moved = label != own
        yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, t) for t in (np.int32, np.int32, np.int64, np.int64)]
        waiting: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            waiting.append([b.column(i).to_numpy() for i in range(4)])
            size += b.num_rows
            if size < gather:
                continue
            cols = [np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held)]
            ends = np.flatnonzero((cols[2][1:] != cols[2][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[0][1:] != cols[0][:-1]))
            stop = int(ends[-1]) + 1 if len(ends) else 0
            if stop:
                yield from solve(*(c[:stop] for c in cols))
            held, waiting, size = [c[stop:] for c in cols], [], 0
        cols = [np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held)]
        if len(cols[0]):
            yield from solve(*cols)

    found = spread.mapInArrow(run, "a long, b long")
    return found.distinct() if direct else found  # a pair can meet in several shards


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``df``.

    ``fingerprint`` has 16 lower-case hex digits. Rows whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest key reachable over links, the row's own included (null only where all those are null).
    Null, empty and wordless texts share fingerprint zero, which is linked like any other. Repeated rows each get the same
    result. Equal fingerprints are first made one; components are found on distinct fingerprints, never on the driver. Only ``key`` and
    ``text`` are read, so other columns may have any name; an empty table gives an empty one.
    """
    rows = cut(fingerprints(df.select(quoted(key).alias("key"), quoted(text).alias("text")), words).drop("text"))
    classes = rows.groupBy("fp").agg(F.min("key").alias("first"))
    found = components(cut(links(rows.select("fp").distinct(), radius)))
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "label").select("fp", "component_id")
    return salted(rows, classes, ["fp"], "key").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar texts: SimHashes of a few shingles each, drawn by their smallest value under random orders.
SAMPLES, SAMPLE_SIZE = 16, 5
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SAMPLES * SAMPLE_SIZE, 1), dtype=np.uint64, endpoint=False)


def sampled(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """SAMPLES SimHashes, each of the SAMPLE_SIZE shingles that come first under as many orders; zeros for no shingle.

    Sets with Jaccard similarity s agree in one with probability s ^ SAMPLE_SIZE: at 0.8 all 16 miss once in 580 times.
    """
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint64)
    xor, factor = _ORDERS[0], _ORDERS[1] | np.uint64(1)
    best, chosen = None, None
    for a in range(0, len(hashes), block):
        part = hashes[a : a + block]
        value = (part ^ xor) * factor
        at = value.argmin(1)
        least, own = np.take_along_axis(value, at[:, None], 1)[:, 0], part[at]
        if best is None:
            best, chosen = least, own
        else:
            chosen = np.where(least < best, own, chosen)
            best = np.minimum(best, least)
    bits = np.unpackbits(chosen.view(np.uint8).reshape(SAMPLES, SAMPLE_SIZE, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(1) * 2 > SAMPLE_SIZE, axis=1, bitorder="little").view(np.uint64)[:, 0]


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, words))


def overlaps(one: np.ndarray, others: list[np.ndarray], block: int = 1 << 18) -> np.ndarray:
    """Jaccard similarities of a set with each of the others; 1 for two empty sets. ``block`` bounds the hashes looked up at once."""
    sizes = np.array([len(x) for x in others], np.int64)
    both = np.zeros(len(others), np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(others) and len(one):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block, "right")))
        every = np.concatenate(others[a:b])
        if len(every):
            hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
            edges = np.concatenate([[0], np.cumsum(sizes[a:b])])
            both[a:b] = np.diff(np.concatenate([[0], np.cumsum(hit)])[edges])
        a = b
    union = len(one) + sizes - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


#: Members that one copy of a hub's text is compared with; sides of the blocks in which what is left of a bucket is compared.
HUB_ROWS, OPEN_ROWS, MEMBER_ROWS = 512, 64, 256
#: The place of the buckets in which texts meet those whose values over all shingles are near.
NEAR = SAMPLES + 1


def similar(pairs: DataFrame, contents: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (hub, node) of ``pairs`` whose texts are similar, as links (a, b); ``contents`` has (node, t).

    A hub's text comes before the texts of its members, so each text is sent once and a hub's set is made once; a hub of many members
    is repeated, with HUB_ROWS of them each.
    """
    copies = F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / HUB_ROWS).cast("int"))).alias("part")
    hubs = pairs.groupBy("hub").count()
    parts = hubs.select("hub", (F.floor((F.col("count") - 1) / HUB_ROWS) + 1).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    members = salted(pairs, parts, ["hub"], "node").select("hub", part, "node").join(contents, "node").select("hub", "part", "node", "t")
    heads = hubs.select("hub", copies).join(contents.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "t")
    rows = heads.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for b in small_batches(batches):
            found: tuple[list, list] = ([], [])
            for hub, node, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                mine = shingle_set(t, words)
                if node is None:
                    head = mine
                elif overlaps(head, [mine])[0] >= similarity:
                    found[0].append(hub)
                    found[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def across(near: DataFrame, owners: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, value, node, label, apart, other): the texts of the pairs of ``near`` (a, b) that are not all connected yet, in buckets.

    ``owners`` has (node, fp). The value with more texts is at home in a bucket: its texts are ``apart``, to be compared with the
    ``other`` ones, all those of each value that it is paired with. So no pair of texts with near values is left out.
    """
    touched = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()
    known = salted(owners, touched, ["fp"], "node").join(labels, "node", "left")
    known = cut(known.select("fp", "node", F.coalesce("label", "node").alias("label")))
    classes = known.groupBy("fp").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    end = lambda k: classes.select(F.col("fp").alias(k), F.struct("n", "fp", "low", "high").alias(f"{k}_class"))
    a, b = F.col("a_class"), F.col("b_class")
    pairs = near.join(end("a"), "a").join(end("b"), "b").where(F.least(a["low"], b["low"]) < F.greatest(a["high"], b["high"]))
    pairs = cut(pairs.select(F.greatest(a, b)["fp"].alias("value"), F.least(a, b)["fp"].alias("fp")))
    rows = lambda df, apart: df.select(F.lit(NEAR).alias("place"), "value", "node", "label", F.lit(apart).alias("apart"), F.lit(not apart).alias("other"))
    home = salted(known, pairs.select(F.col("value").alias("fp")).distinct(), ["fp"], "node").withColumn("value", F.col("fp"))
    homes = pairs.groupBy("fp").agg(F.collect_list("value").alias("homes"))  # no more than there are values within the radius
    guests = salted(known, homes, ["fp"], "node").withColumn("value", F.explode("homes"))
    return rows(home, True).union(rows(guests, False))


def left_over(members: DataFrame, labels: DataFrame, contents: DataFrame, words: int, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """(a, b): links in buckets whose members are not all connected to the bucket's root, and in the buckets ``more`` (see ``across``).

    Each such member is compared with all members of its bucket that have another label, in blocks of OPEN_ROWS by MEMBER_ROWS. So
    a bucket, (place, value, node, root), is resolved in full, whatever its root resembles.
    """
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    known = members.join(of("node"), "node", "left")
    known = salted(known, of("root"), ["root"], "node", "left")
    known = known.select("place", "value", "node", F.coalesce("node_label", "node").alias("label"), (F.coalesce("node_label", "node") != F.coalesce("root_label", "root")).alias("apart"), F.lit(True).alias("other"))
    known = cut(known if more is None else known.union(more))
    blocks = lambda n, size: (F.floor((n - 1) / size) + 1).cast("int")
    buckets = known.groupBy("place", "value").agg(F.count_if("other").alias("n"), F.count_if("apart").alias("open")).where(f"open > 0 and (n > 2 or place = {NEAR})")
    buckets = buckets.select("place", "value", blocks(F.col("open"), OPEN_ROWS).alias("nu"), blocks(F.col("n"), MEMBER_ROWS).alias("nm"))
    placed = salted(known, buckets, ["place", "value"], "node").join(contents, "node")

    def sets(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"set": pa.array([shingle_set(t, words).tobytes() for t in texts(batch, "t")], pa.binary())}

    placed = with_columns(placed, "set binary", sets).drop("t")
    deal = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), n).cast("int")
    cell = lambda ub, mb, opened: F.struct(ub.alias("ub"), mb.alias("mb"), F.lit(opened).alias("opened"))
    row = F.transform(F.sequence(F.lit(0), F.col("nu") - 1), lambda ub: cell(ub, deal(F.col("nm")), False))
    col = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda mb: cell(deal(F.col("nu")), mb, True))
    cells = F.concat(*[F.when(F.col(role), of).otherwise(F.slice(of, 1, 0)) for role, of in (("other", row), ("apart", col))])
    spread = placed.select("place", "value", F.explode(cells).alias("c"), "node", "label", "set").select("place", "value", "c.*", "node", "label", "set")

    def solve(t: pa.Table) -> pa.Table:
        a, b = [], []
        opened, node, label = (t.column(c).to_numpy() for c in ("opened", "node", "label"))
        every = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size, others = np.array([len(x) for x in every], np.int64), np.flatnonzero(~opened)
        for i in np.flatnonzero(opened).tolist():
            # no more than the smaller set can be shared
            near = np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])
            may = others[near & (label[others] != label[i])]
            hit = may[overlaps(every[i], [every[j] for j in may]) >= similarity] if len(may) else may
            a += [int(node[i])] * len(hit)
            b += node[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("place", "value", "ub", "mb").applyInArrow(solve, "a long, b long").distinct()


def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2, text: str = "text") -> DataFrame:
    """(node, label) for the distinct texts of ``df`` that have a similar one; ``node`` is xxhash64 of the text (null: empty).

    Texts meet in buckets: by the SimHash over all their shingles, and by each of the ``sampled`` SimHashes; the first also meet all those within
    ``radius`` bits, through the BK-trees. A bucket's members are compared with its root (drawn at random for each bucket), and
    members that this leaves unconnected with all others of the bucket; of the values within ``radius`` one is compared with the first, root with
    root, then all their texts that are not connected. So every link between two texts that meet is found. Texts of
    similarity 0.8 share no bucket once in 580 times, at 0.9 once in 10 million. A link is a Jaccard similarity of the shingle sets
    of ``similarity`` or more; labels are components of links. Equal texts are one node, and texts without words are similar to each other only.
    An empty table and one without similar texts give no rows.
    """
    node = F.xxhash64(F.coalesce(quoted(text), F.lit(""))).alias("node")
    given = df.select(quoted(text).alias("text"), node)

    def prints(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [shingle_hashes(t, words) for t in texts(batch, "text")]
        whole = [majority(h) for h in found]
        values = [[*sampled(h).view(np.int64).tolist(), w - (1 << 64) if w >> 63 else w] for h, w in zip(found, whole, strict=True)]
        return {"prints": pa.array(values, pa.list_(pa.int64()))}

    nodes = cut(with_columns(given, "prints array<long>", prints).drop("text").dropDuplicates(["node"]))
    values = nodes.select("node", F.posexplode("prints").alias("place", "value"))
    # a root drawn by a hash of its own in each place: each text meets other roots in other places
    draw = F.min(F.struct(F.xxhash64("node", "place").alias("by"), "node"))["node"].alias("root")
    roots = values.groupBy("place", "value").agg(draw, F.count("*").alias("n"))
    members = cut(salted(values, roots.where("n > 1").drop("n"), ["place", "value"], "node"))
    classes = roots.where(F.col("place") == SAMPLES).select(F.col("value").alias("fp"), "root")
    near = cut(links(classes.select("fp"), radius, direct=True))
    first = near.union(near.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
    close = first.join(classes.select(F.col("fp").alias("a"), F.col("root").alias("node")), "a").join(classes.select(F.col("fp").alias("b"), F.col("root").alias("hub")), "b").select("hub", "node")
    pairs = cut(members.where("node <> root").select(F.col("root").alias("hub"), "node").union(close).distinct())
    wanted = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).distinct()
    # copies of a text meet in their own tasks first, then one text of each node is looked up
    contents = given.select("node", F.coalesce("text", F.lit("")).alias("t")).groupBy("node").agg(F.first("t").alias("t"))
    contents, spent = write_table(contents.join(wanted, "node", "left_semi"))
    found = cut(similar(pairs, contents, words, similarity))
    labels = components(found)
    owners = values.where(F.col("place") == SAMPLES).select("node", F.col("value").alias("fp"))
    more = cut(left_over(members, labels, contents, words, similarity, across(near, owners, labels)))
    if not more.isEmpty():
        labels = components(found.union(more))
    remove(df.sparkSession, spent)
    return labels


def first_of_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without near duplicates: of each group of equal or similar texts (see ``similar_groups``) the row with the smallest key.

    A null key comes after all others; of rows with equal keys and texts one stays. Rows whose text has no similar one all
    stay. Rows are chosen by key and hash of the text, so texts are shuffled once and never numbered. Columns keep their names and
    values; an empty table gives an empty result.
    """
    mine = free_name(df, "node")
    rows = df.withColumn(mine, F.xxhash64(F.coalesce(quoted(text), F.lit(""))))
    labels = similar_groups(df.select(quoted(text).alias("text")), words, similarity)
    order = F.struct(quoted(key).isNull().alias("none"), quoted(key).alias("key"), quoted(mine).alias("node"))
    classes = rows.select(quoted(mine).alias("node"), order.alias("least")).groupBy("node").agg(F.min("least").alias("least")).join(labels, "node", "left")
    first = classes.groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("least").alias("least"))
    wnode, wkey = (free_name(rows, n) for n in ("wnode", "wkey"))
    wins = first.select(F.col("least.node").alias(wnode), F.col("least.key").alias(wkey))
    same = (quoted(mine) == quoted(wnode)) & quoted(key).eqNullSafe(quoted(wkey))
    return rows.join(wins, same, "left_semi").dropDuplicates([mine, key]).select(*map(quoted, df.columns))
