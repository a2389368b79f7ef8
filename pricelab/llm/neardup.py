"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. In a sketch every
shingle flips one bit of a very wide segment (2**64 bits, named by the XOR of the
hashes of the bits that are set), so the Hamming distance of two sketches is at most the
size of the symmetric difference. Sets of Jaccard similarity at least
``percent`` / 100 differ in at most

    D = (|A| + |B|) * (100 - percent) div (100 + percent)

elements. Sizes fall into bands, each up to 100 / percent times as wide as it
begins, so partners are in one band or in neighbouring ones; a level joins a
band with itself and the next. The level's sketch has more than D
``segments``, and D changed shingles leave at least one segment of the
sketch as it was (pigeonhole): (level, place, segment) is a join key. Segments that no
shingle falls into say nothing and are no keys; a set with too few others
for the pigeonhole to hold without them adds its empty segments as keys.

The keys of all blocks go through the fingerprint exchange; only keys that occur
twice become rows. As at most D segments change, a set with a link shares all its filled segments of the level but
D: sets that share fewer keys, as those with only a common passage, have no link there and go no further. Sets that share a key are a group (keys of the same sets are one
group), and links are verified within groups:

1. In groups of up to ``SLOT`` sets, short sketches drop the sets that no other one of the group can be linked with.
2. Each set goes once to its largest group, in slots of ``SLOT``, where a search verifies links: from each
   set found it compares, by sketches first and by the sets themselves where the
   sketches allow a link, with those not found yet. The links are a forest.
3. Linked sets are one component from then on. In groups of several slots a few sets of each component are
   compared next, each component in its largest group, so the parts of a large group of near copies grow together.
4. Groups that still hold several components, and were not compared as a whole, are compared across
   components: those that share sets together, where they are ``SLOT`` sets at most; else group by group, the largest
   component's sets against the others', and the others' among each other, slot by slot. There is one link for two
   components that are found linked.

So a group of near copies gives links in proportion to its sets, and a set moves again only where components
stay apart. Never are all pairs of a group of copies compared or emitted.

Copies (equal sets) are one node. Documents without words, or without text, have
an empty set and no links. A null doc_id sorts last. Rows repeated with the same
doc_id are a document each. Nodes are named by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, SLICE_ROWS, Block, pack, rows_of
from .common import one_each, stored
from .components import components
from .exchange import marked, shared, with_answers
from .hashing import MULT, mix, shingle_sets

SLOT = 1000  # sets: a larger group is verified slot by slot


class Levels:
    """Bands of sizes, and for each level the number of segments of its sketch."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.first = percent, [1]
        while self.first[-1] <= largest:
            self.first.append(self.first[-1] * 100 // percent + 1)
        most = [self.differ(b - 1, (b - 1) * 100 // percent) for b in self.first[1:]]
        self.most = np.array(most, np.int64)
        self.segments = np.array([ceil((d + 1) * 1.1) + 2 for d in most], np.int64)

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def keys(self, doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of all documents' sets."""
        return self.keyed(doc, h, count)[:2]

    def keyed(self, doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, side) of all documents' sets, and for each side (0: the set's own level, 1: the one below) and
        document the fewest keys of the side that the set shares with any set that it is linked with there."""
        need = np.ones((2, len(count)), np.int64)
        band = np.searchsorted(self.first, count, side="right") - 1  # -1: empty set
        found = []
        for below in (0, 1):
            level = band - below
            use = (level >= 0) & (count > 0)
            parts = self.segments[np.maximum(level, 0)]
            t = use[doc]
            d, x = doc[t], h[t]
            if not len(d):
                continue
            place = ((x >> np.uint64(32)) * parts[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (place[1:] != place[:-1])])
            word = np.bitwise_xor.reduceat(mix(x), start)
            d, place = d[start], place[start]
            filled = word != 0
            found.append((d[filled], self._key(level[d], place, word)[filled], np.full(filled.sum(), below)))
            full = np.bincount(d[filled], minlength=len(count))
            need[below] = np.maximum(1, full - self.most[np.maximum(level, 0)])
            for k in np.flatnonzero(use & (full <= self.most[np.maximum(level, 0)])):
                empty = np.setdiff1d(np.arange(parts[k]), place[filled & (d == k)])
                found.append((np.full(len(empty), k), self._key(np.full(len(empty), level[k]), empty, np.zeros(len(empty), np.uint64)), np.full(len(empty), below)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), need
        return *(np.concatenate(x) for x in zip(*found)), need

    @staticmethod
    def _key(level, place, word) -> np.ndarray:
        return mix(mix(word * np.uint64(MULT) + level.astype(np.uint64)) + place.astype(np.uint64))


def _sets(b: Block, width: int):
    """(document, hash, size of each set, node of each set)."""
    doc, h = shingle_sets(b.bytes(), b.starts, b.sizes, width)
    count = np.bincount(doc, minlength=len(b.ids))
    node = np.zeros(len(b.ids), np.uint64)
    have = np.flatnonzero(count)
    if len(have):
        at = (np.cumsum(count) - count)[have]
        node[have] = mix(np.add.reduceat(mix(h + np.uint64(MULT)), at) * np.uint64(MULT) + np.bitwise_xor.reduceat(mix(h), at) + count[have].astype(np.uint64))
    return doc, h, count, node.view(np.int64)


def linked(a: int, b: int, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def sketches(flat: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """A parity sketch for each set (a row of 64-bit words): every hash flips one bit."""
    words = np.zeros(len(size) * bits // 64, np.uint64)
    bit = ((flat >> np.uint64(20)) % np.uint64(bits)).astype(np.int64) + np.repeat(np.arange(len(size)) * bits, size)
    np.bitwise_xor.at(words, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    return words.reshape(len(size), -1)


def allowed(sketch: np.ndarray, size: np.ndarray, k: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of ``others`` those that sizes and sketches allow a link with set ``k``."""
    near = others[(100 * size[others] >= percent * size[k]) & (100 * size[k] >= percent * size[others])]
    apart = np.bitwise_count(sketch[near] ^ sketch[k]).sum(1)
    return near[apart <= (size[near] + size[k]) * (100 - percent) // (100 + percent)]


def roots(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each set, the first set of its component under links (an index); sets of one ``label`` are linked already."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    begin = np.cumsum(size) - size
    bits = 64 * int(np.clip(ceil(4 * (2 * size.max() * (100 - percent) / (100 + percent) + 1) / 64), 4, 256))
    sketch = sketches(flat, size, bits)
    kind = np.unique(label, return_inverse=True)[1] if label is not None else np.arange(n)
    by_kind = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    root = np.full(n, -1)
    open_ = np.arange(n)
    while len(open_):
        top, queue = open_[0], by_kind[kind[open_[0]]].tolist()
        root[queue] = top
        open_ = open_[root[open_] < 0]
        while queue and len(open_):
            a = queue.pop()
            near = allowed(sketch, size, a, open_, percent)
            if not len(near):
                continue
            idx = np.repeat(begin[near] - (np.cumsum(size[near]) - size[near]), size[near]) + np.arange(size[near].sum())
            x = flat[idx]
            at = np.minimum(np.searchsorted(sets[a], x), size[a] - 1)
            both = np.add.reduceat((sets[a][at] == x).astype(np.int64), np.cumsum(size[near]) - size[near])
            hit = near[linked(size[a], size[near], both, percent)]
            if len(hit):
                new = np.concatenate([by_kind[k] for k in np.unique(kind[hit])])
                root[new] = top
                queue.extend(new.tolist())
                open_ = open_[root[open_] < 0]
    return root


SKETCH_BITS = 512  # of the sketch that goes with a set's name


def _groups(found: DataFrame) -> DataFrame:
    """(grp, n, node): the different groups of sets that share a key; ``n`` sets each."""
    keys = found.select("node", F.explode("keys").alias("key")).distinct()
    of = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    of = of.groupBy("n", "x", "y").agg(F.min("key").alias("grp"))  # keys of the same sets
    of = stored(of.select(F.col("grp").alias("g"), "n"), "groups")
    return stored(keys.join(of, F.col("key") == F.col("g")).select(F.col("g").alias("grp"), "n", "node"), "members")


def _possible(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The members that the sketches allow a link in their group; all members of a large group."""
    names = found.select(F.col("node").alias("m"), "size", "sketch").dropDuplicates(["m"])
    small = members.where(F.col("n") <= SLOT)
    rows = small.join(names, F.col("node") == F.col("m")).select("grp", "n", "node", "size", "sketch")
    tasks = max(1, ceil((small.count() or 1) / 20_000))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, g in pdf.groupby("grp"):
            size = g["size"].to_numpy()
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
            ok, every = np.zeros(len(g), bool), np.arange(len(g))
            for k in range(len(g)):
                if not ok[k]:
                    near = allowed(sketch, size, k, every, percent)
                    if len(near) > 1:
                        ok[near] = True
            keep.append(g.loc[ok, ["grp", "n", "node"]])
        return pd.concat(keep)

    rows = rows.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks)))
    some = rows.groupBy("task").applyInPandas(check, "grp long, n long, node long")
    left = some.unionByName(members.where(F.col("n") > SLOT).select("grp", "n", "node"))
    left = stored(left, "possible")
    n = left.groupBy("grp").agg(F.count("*").alias("left")).where("left > 1").withColumnRenamed("grp", "g")
    return stored(left.join(n, F.col("grp") == F.col("g")).select("grp", F.col("left").alias("n"), "node"), "possible")


def _links(tiles: DataFrame, sets: DataFrame, percent: int, tile_rows: int = 2000) -> DataFrame:
    """Links (a, b) between the labels of each tile: ``tiles`` (tile, node, label), each set read by its node."""
    tiles = stored(tiles, "tiles")
    rows = tiles.join(sets.select(F.col("node").alias("m"), "set"), F.col("node") == F.col("m")).select("tile", "label", "set")
    tasks = max(1, ceil(tiles.count() / tile_rows) * 4)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, g in pdf.groupby("tile"):
            label = g["label"].to_numpy()
            root = roots([np.frombuffer(s, np.uint64) for s in g["set"]], percent, label)
            pairs = np.unique(np.stack([label, label[root]]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            a.append(pairs[0])
            b.append(pairs[1])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = rows.withColumn("task", F.pmod(F.xxhash64("tile"), F.lit(tasks)))
    return stored(rows.groupBy("task").applyInPandas(verify, "a long, b long").distinct(), "links")


def _verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all sets that have a link."""
    slots = lambda n: F.ceil(n / F.lit(SLOT)).cast("long")
    slot = lambda n: F.pmod(F.xxhash64(F.lit(2), "node"), slots(n))
    # 2. each set once, in its largest group
    main = members.groupBy("node").agg(F.max(F.struct("n", "grp")).alias("g")).select("node", "g.n", "g.grp")
    main = stored(main, "main")
    links = _links(main.select(F.xxhash64("grp", slot(F.col("n"))).alias("tile"), "node", F.col("node").alias("label")), sets, percent)
    whole = main.where(F.col("n") <= SLOT).groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("c"))
    rest = members.join(whole, F.col("grp") == F.col("g"), "left").where("c is null or c < n").select("grp", "n", "node")

    rest = stored(rest, "rest")

    def open_groups(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components, and (grp, n, node, label) of the groups that hold several."""
        labels = components(links)
        now = rest.join(labels.select(F.col("node").alias("m"), "label"), F.col("node") == F.col("m"), "left").select("grp", "n", "node", F.coalesce("label", "node").alias("label"))
        several = now.groupBy(F.col("grp").alias("g")).agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
        return labels, stored(now.join(several, F.col("grp") == F.col("g")).select("grp", "n", "node", "label"), "open")

    labels, left = open_groups(links)
    # 3. some of each component, in its largest group of several slots
    for _ in range(3):
        large = left.where(F.col("n") > SLOT)
        if large.isEmpty():
            break
        best = large.groupBy(F.col("label").alias("b")).agg(F.max(F.struct("n", "grp"))["grp"].alias("g"))
        large = large.join(best, (F.col("label") == F.col("b")) & (F.col("grp") == F.col("g"))).select("grp", "n", "node", "label")
        order = Window.partitionBy("grp", "label").orderBy(F.xxhash64("node"))
        some = large.withColumn("k", F.row_number().over(order)).where("k <= 4").drop("k")
        n = some.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("w"))
        some = some.join(n, F.col("grp") == F.col("g"))
        more = _links(some.select(F.xxhash64("grp", slot(F.col("w"))).alias("tile"), "node", "label"), sets, percent)
        if more.isEmpty():
            break
        links = stored(links.unionByName(more), "links")
        labels, left = open_groups(links)
    if left.isEmpty():
        return labels
    # 4. across components. What hangs together over open groups is one tile if it is small: a set moves once
    star = left.groupBy(F.col("grp").alias("g")).agg(F.min("node").alias("a"))
    near = components(left.join(star, F.col("grp") == F.col("g")).select("a", F.col("node").alias("b")))
    many = near.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("in_all"))
    near = near.join(many, F.col("label") == F.col("l")).select(F.col("node").alias("m"), F.col("l").alias("cluster"), "in_all")
    left = stored(left.join(near, F.col("node") == F.col("m")).drop("m"), "open")
    together = left.where(F.col("in_all") <= SLOT).select(F.xxhash64(F.lit(3), "cluster").alias("tile"), "node", "label").distinct()
    left = left.where(F.col("in_all") > SLOT)
    # in large clusters group by group, the largest component (side 0) against the others (side 1), and those among each other
    size = left.groupBy("grp", "label").agg(F.count("*").alias("c"))
    size = size.groupBy(F.col("grp").alias("g")).agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    size = size.select("g", F.when(F.col("all") > SLOT, F.col("top.label")).alias("top"), "top.c", "all")
    rows = left.join(size, F.col("grp") == F.col("g")).withColumn("side", F.when(F.col("label") == F.col("top"), 0).otherwise(1))
    own, others = F.coalesce(slots(F.when(F.col("top").isNotNull(), F.col("c"))), F.lit(0)), slots(F.col("all") - F.when(F.col("top").isNotNull(), F.col("c")).otherwise(0))
    rows = rows.withColumn("own", own).withColumn("others", others)
    rows = rows.withColumn("s", F.pmod(F.xxhash64(F.lit(2), "node"), F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("others"))))
    zero, last = F.lit(0).cast("long"), F.col("others") - 1
    with_own = F.when(F.col("own") > 0, F.transform(F.sequence(zero, F.greatest(F.col("own") - 1, zero)), lambda x: F.concat_ws("-", F.lit("a"), x, F.col("s")))).otherwise(F.array().cast("array<string>"))
    among = F.transform(F.sequence(zero, last), lambda x: F.concat_ws("-", F.lit("b"), F.least(x, F.col("s")), F.greatest(x, F.col("s"))))
    tiles = F.when(F.col("side") == 0, F.transform(F.sequence(zero, last), lambda x: F.concat_ws("-", F.lit("a"), F.col("s"), x))).otherwise(F.concat(with_own, among))
    rows = rows.select("grp", "node", "label", F.explode(tiles).alias("t")).select(F.xxhash64("grp", "t").alias("tile"), "node", "label")
    more = _links(rows.unionByName(together), sets, percent)
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
                    block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    out = decide(docs, words, percent, text, doc_id, block_bytes)
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def decide(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 1 << 20) -> DataFrame:
    """id, n, node, component (as ids) and first (the row's set is the one that stays for its component) for every row."""

    def nodes(b: Block) -> dict[str, bytes]:
        _, _, count, node = _sets(b, words)
        return {"counts": count.astype(np.int64).tobytes(), "nodes": node.tobytes()}

    blocks = pack(docs, text, doc_id, block_bytes, nodes, "counts binary, nodes binary")
    names = _explode(blocks, words)
    total = names.agg(F.max("n").alias("largest"), F.sum("n").alias("all")).collect()[0]
    if not total["largest"]:
        return names.select("id", "n", "node", F.col("id").alias("component"), F.lit(True).alias("first"))
    levels = Levels(percent, total["largest"])

    def distinct(b: Block) -> tuple[np.ndarray, ...]:
        """Sets and keys (``Levels.keyed``) of the block's different sets."""
        doc, h, count, node = _sets(b, words)
        first = np.zeros(len(node), bool)
        first[np.unique(node, return_index=True)[1]] = True
        first &= count > 0
        keep = first[doc]
        doc, h, count = doc[keep], h[keep], np.where(first, count, 0)
        return (doc, h, count, node, *levels.keyed(doc, h, count))

    def prints(row: dict) -> np.ndarray:
        return np.unique(distinct(Block(row["ids"], row["sizes"], row["data"]))[5])

    parts = blocks.select("block", "ids", "sizes", "data")
    share = 2 * (100 - percent) / percent  # keys a shingle, over two levels
    answers = shared(parts, prints, int(total["all"] * share))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                doc, h, count, node, kdoc, key, side, need = distinct(Block(row["ids"], row["sizes"], row["data"]))
                uniq, inv, n = np.unique(key, return_inverse=True, return_counts=True)
                often = n > 1
                if row["answer"]:
                    often |= marked(row["answer"])
                hit = often[inv]
                several = np.bincount(side[hit] * len(count) + kdoc[hit], minlength=2 * len(count)).reshape(2, -1)
                hit &= (several >= need)[side, kdoc]  # else no link: it would leave more keys of the side as they are
                begin = np.cumsum(count) - count
                order = np.argsort(kdoc[hit], kind="stable")
                kd, kk = kdoc[hit][order], key[hit][order]
                at, cut = np.unique(kd, return_index=True)
                keys = np.split(kk, cut[1:]) if len(at) else []
                if len(at):
                    each = [h[begin[d] : begin[d] + count[d]] for d in at]
                    sketch = sketches(np.concatenate(each), count[at], SKETCH_BITS)
                    yield pa.record_batch([pa.array(node[at]), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(count[at].astype(np.int64)),
                                           pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())],
                                          names=["node", "keys", "size", "sketch", "set"])

    found = stored(with_answers(parts, answers).mapInArrow(suspects, "node long, keys array<long>, size long, sketch binary, set binary"), "suspects")
    members = _possible(_groups(found), found, percent)
    # A set that several blocks hold is one already in the task that reads it, before anything moves: an inner join, since a
    # semi join would be pushed below the aggregate.
    sets = found.groupBy("node").agg(F.first("set").alias("set"))
    left = stored(members.select(F.col("node").alias("m")).distinct(), "left")
    sets = sets.join(left, F.col("node") == F.col("m")).select("node", "set")
    return _named(names, _verified(members, stored(sets, "sets"), percent))


def _explode(blocks: DataFrame, words: int) -> DataFrame:
    """(id, n, node) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.record_batch([pa.array(np.frombuffer(x, np.int64)) for x in cols], names=["id", "n", "node"])

    return blocks.select("ids", "counts", "nodes").mapInArrow(each, "id long, n long, node long")


def _named(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest id of every component: first a table of nodes, then of components, each joined from a table of its own."""
    nodes = stored(names.where("n > 0").groupBy("node").agg(F.min("id").alias("least")), "nodes")
    nodes = stored(nodes.join(labels.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", F.coalesce("label", "node").alias("label"), "least"), "nodes")
    least = F.min(F.struct("least", "node"))
    whole = stored(nodes.groupBy("label").agg(least["least"].alias("component"), least["node"].alias("top")).withColumnRenamed("label", "l"), "components")
    nodes = stored(nodes.join(whole, F.col("label") == F.col("l")).select(F.col("node").alias("m"), "component", (F.col("node") == F.col("top")).alias("first")), "nodes")
    out = names.join(nodes, (F.col("node") == F.col("m")) & (F.col("n") > 0), "left")
    return out.select("id", "n", "node", F.coalesce("component", "id").alias("component"), F.coalesce("first", F.lit(True)).alias("first"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of every component, one of those with its smallest doc_id; all rows without words."""

    @F.pandas_udf("long")
    def set_node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            nodes = []
            for k in range(0, len(s), SLICE_ROWS):
                raw = s.iloc[k : k + SLICE_ROWS].tolist()
                b = Block(np.arange(len(raw)).tobytes(), np.fromiter(map(len, raw), np.int64, len(raw)).tobytes(), None)
                b.raw = b"".join(raw)
                _, _, count, node = _sets(b, words)
                nodes.append(np.where(count > 0, node, 0))
            yield pd.Series(np.concatenate(nodes) if nodes else np.empty(0, np.int64))

    decided = decide(docs, words, percent, text, doc_id, **how).where("n > 0").select("id", F.col("node").alias("key"), (F.col("first") & (F.col("id") == F.col("component"))).alias("kept"))
    return one_each(docs, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), set_node(F.coalesce(F.col(text), F.lit("")).cast("binary")), decided)
