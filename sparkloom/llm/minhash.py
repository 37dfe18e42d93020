"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set is its distinct word shingles. Documents with equal sets meet first
and go on as one node, named by a hash of the set. Each node has a signature of COUNTED
minima. The first POSTED of them are posted: a node stands under each pair of
coordinate and value. Two sets of the wanted similarity share MATCHES of the posted
pairs, so of a node's pairs, rarest first, only the first POSTED - MATCHES + 1 need to
be looked at (prefix), nodes with that many pairs of their own drop out, and the
frequent pairs are seldom opened (skip). Nodes that meet there count how many of all
their minima agree, and pairs above a threshold are confirmed on the full sets.

Of the agreeing pairs of one posting only a forest goes on, which joins all nodes
that they join: m nodes give less than m pairs. Its trees are the clusters in which
all links lie. Each node's full set is sent to its cluster once, where links are
confirmed by counting shared shingles over the cluster's inverted lists, and again
only a forest of links comes out. No pair of nodes is ever a row of its own.

Postings of more than BLOCK nodes and clusters of more than BLOCK_SHINGLES shingles
are dealt out as pairs of blocks, so none has to fit in one task. The thresholds lie
five standard deviations below what sets of the wanted similarity share on average.

Null and empty texts have an empty set and are linked with nothing, as are rows with
a null id (component_id null, kept). Texts with fewer words than a shingle are one
shingle. Rows that share an id but not a set link the nodes of all their sets, as an id
is in one component. Other columns are left out.
"""

from __future__ import annotations

from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import A, B, C, bounded, join, mix, words_of
from .storage import kept

POSTED, COUNTED, BLOCK, BLOCK_SHINGLES, HOT, BATCH_BYTES = 64, 256, 4096, 1_000_000, 1000, 1 << 21
_MULTIPLIER = (mix(np.arange(1, COUNTED + 1, dtype=np.uint64) * B) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSET = (mix(np.arange(1, COUNTED + 1, dtype=np.uint64) * C) >> np.uint64(32)).astype(np.uint32)


def threshold(of: int, similarity: float, deviations: float = 5.0) -> int:
    return max(1, floor(of * similarity - deviations * sqrt(of * similarity * (1 - similarity))))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    sets = []
    for w in words_of([(t or b"").lower() for t in texts]):
        if len(w) > size:
            h = w
            for k in range(1, size):
                h = join(h[:-1], w[k:])
            sets.append(np.unique(h))
        elif len(w):
            h = w[:1]
            for k in range(1, len(w)):
                h = join(h, w[k : k + 1])
            sets.append(h if len(w) == size else mix(h + A))
        else:
            sets.append(w)
    return sets


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(16)).astype(np.uint32)
    out = np.full(COUNTED, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        part = np.multiply.outer(_MULTIPLIER, x[a : a + 2048])
        part += _OFFSET[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("posted", pa.binary()), ("counted", pa.binary())])


def _sign(size: int):
    def run(batches):
        for batch in batches:
            for part in bounded(batch, 1, BATCH_BYTES):
                rows = []
                for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), size), strict=True):
                    m = signature(s)
                    rows.append((i, len(s), _key(s, A), _key(s, C), m[:POSTED].tobytes(), (m & 255).astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SIGNED, strict=True)], schema=_SIGNED)

    return run


def _post(batches):
    """A row for each posted coordinate of each node."""
    place = np.arange(POSTED, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, POSTED)
            tokens = mix(values | place).astype(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(part.column(0).to_numpy(), POSTED))], ["token", "node"])


def _forest(nodes: np.ndarray, counted: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that join all nodes of one posting that pairs with enough equal minima join."""
    root, pairs = np.arange(len(nodes)), []
    for x in range(len(nodes) - 1):
        other = np.flatnonzero(root[x + 1 :] != root[x]) + x + 1
        near = other[(counted[other] == counted[x]).sum(axis=1) >= least]
        for y in near:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                pairs.append((nodes[x], nodes[y]))
    return pairs


def _links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that join all nodes of one cluster that links join, by shared shingles of the full sets."""
    size = np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)))
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(nodes)), size)
    order = np.argsort(shingle, kind="stable")
    lists, ends = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    root, pairs = np.arange(len(nodes)), []
    for x in range(len(nodes) - 1):
        if (root == root[0]).all():
            break
        own = shingle[begin[x] : begin[x + 1]]
        n = ends[own + 1] - ends[own]
        at = np.repeat(ends[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(lists[at], minlength=len(nodes))
        linked = np.flatnonzero(100 * shared >= percent * (size[x] + size - shared))
        for y in linked[linked > x]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                pairs.append((nodes[x], nodes[y]))
    return pairs


_PAIR = ["a", "b"]


def _by_group(keys: tuple[str, ...], pairs_of):
    """Runs pairs_of over each run of rows with equal keys, in partitions sorted by them; one group is held at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solved(t: pa.Table, cut: np.ndarray):
            found = [p for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1 for p in pairs_of(t.slice(a, b - a))]
            found = list(dict.fromkeys(found))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], _PAIR)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [tuple(part.column(k)[i].as_py() for k in keys) for part, i in ((held[0], 0), (batch, batch.num_rows - 1))]
            if ends[0] == ends[1]:
                continue  # the group goes on
            t = pa.Table.from_batches(held)
            key = np.stack([t.column(k).to_numpy() for k in keys])
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
            yield solved(t, cut)
            held = t.slice(int(cut[-1])).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield solved(t, np.array([0, t.num_rows]))

    return run


def _posting(least: int):
    def pairs(t: pa.Table):
        nodes = t.column("node").to_numpy()
        first = np.unique(nodes, return_index=True)[1]
        counted = np.frombuffer(b"".join(t.column("counted").to_pylist()), np.uint8).reshape(-1, COUNTED)
        return _forest(nodes[first], counted[first], least)

    return pairs


def _cluster(percent: int):
    def pairs(t: pa.Table):
        nodes = t.column("node").to_numpy()
        first = np.unique(nodes, return_index=True)[1]
        sets = t.column("set").to_pylist()
        return _links(nodes[first], [np.frombuffer(sets[i], np.uint64) for i in first], percent)

    return pairs


def _sets(size: int):
    """The full set of each node's text, if the text is the node's."""

    def run(batches):
        for batch in batches:
            for part in bounded(batch, 1, BATCH_BYTES):
                rows = []
                for node, k1, k2, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), shingle_sets(part.column(1).to_pylist(), size), strict=True):
                    if _key(s, A) == k1 and _key(s, C) == k2:
                        rows.append((node, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "set"])

    return run


def _key(s: np.ndarray, x: np.uint64) -> int:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(s ^ x), dtype=np.uint64).astype(np.int64))


def _in_blocks(rows: DataFrame, blocks, keys: list[str]) -> DataFrame:
    """Each row once for each pair of blocks that its own block is in."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return dealt.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node")


def _grouped(rows: DataFrame, keys: list[str], pairs) -> DataFrame:
    keys = [*keys, "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_group(tuple(keys), pairs), "a long, b long").distinct()


def _told(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows with the component of their set. Sets that more than a thousandth of the rows have, a thousand at most, are broadcast; they would each meet in one task."""
    most = sets.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"] / HOT
    hot, rest = (sets.where(c).select("node", "component") for c in (F.col("times") > most, F.col("times") <= most))
    first = rows.join(F.broadcast(hot), "node", "left")
    cold = first.where("component IS NULL").drop("component").join(rest.hint("merge"), "node", "left")
    return first.where("component IS NOT NULL").unionByName(cold)


def _members(nodes: DataFrame, matches: int, least: int) -> DataFrame:
    """node, component, first (an id that has the set), k1, k2 and n of the nodes that agree with another one on enough of their minima; the work behind it can be freed once it is written."""
    posted = nodes.select("node", "posted").mapInArrow(_post, "token long, node long")
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    frequent = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("pairs"))
    prefix = F.slice("pairs", 1, F.greatest(F.lit(0), F.size("pairs") - matches + 1))
    opened = frequent.select("node", F.explode(prefix).alias("p")).select("node", "p.df", "p.token")
    opened = _in_blocks(opened, F.greatest(F.lit(1), F.ceil(F.col("df") / BLOCK)), ["token"])
    near = _grouped(opened.join(nodes.select("node", "counted"), "node"), ["token"], _posting(least))
    return kept(components(near).join(nodes.select("node", "first", "k1", "k2", "n"), "node"))


def _confirmed(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of a and b that join, in each cluster of members, all that links confirmed on full sets join."""
    large = members.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    owners = members.select("node", "first", "k1", "k2")
    sets = texts.join(owners, texts["doc_id"] == owners["first"]).select("node", "text", "k1", "k2").mapInArrow(_sets(size), "node long, set binary")
    dealt = _in_blocks(members.join(large, "component"), F.col("blocks"), ["component"])
    return kept(_grouped(dealt.join(sets, "node"), ["component"], _cluster(percent)))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept (whether it is the row's own) of each row."""
    similarity = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = kept(texts.mapInArrow(_sign(size), "doc_id long, n long, k1 long, k2 long, posted binary, counted binary"))
    signed = signed.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("k1", "k2")))
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = real.groupBy("node", "k1", "k2").agg(F.min("doc_id").alias("first"), F.first("posted").alias("posted"), F.first("counted").alias("counted"), F.first("n").alias("n"))
    links = _confirmed(texts, _members(nodes, threshold(POSTED, similarity), threshold(COUNTED, similarity)), size, percent)

    several = real.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same_id = real.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()
    joined = components(links.unionByName(same_id)).withColumnRenamed("component", "root")
    sets = real.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).join(joined, "node", "left")
    least = sets.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    sets = sets.join(least, "root", "left").select("node", "times", F.coalesce("component", "least").alias("component"))
    found = _told(signed.select("doc_id", "n", "node"), sets)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs, size, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
