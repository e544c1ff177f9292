"""SimHash near-duplicates: exact links by vantage-point trees over fingerprint blocks.

Two fingerprints that differ in at most ``bits`` places differ in at most
``bits // VIEWS`` places of one of ``VIEWS`` equal blocks of their bits. Each
view is a vantage-point tree under the Hamming distance of its block: a node
has a vantage point and a radius, the points within go one way and the others
the other way, and a query goes to both only where the triangle inequality
cannot rule one out. A leaf is a shard. A fingerprint is stored in one shard of
each view and asks every shard that its ball overlaps, so no pair is lost; the
whole distance of 64 bits then decides.

A block of 16 bits has 65,536 values, so a tree is built from their counts (a
table of that size for any number of documents) and is a lookup from value to
shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import pick, text_key
from panelkit.llm.components import components
from panelkit.session import scratch_path

VIEWS = 4
BLOCK = 16
LEAF_POINTS = 1_024  # a shard with fewer points is not split further
CHUNK = 2_048
DEEP_PAIRS = 1 << 26  # a shard with more pairs of a point and a query is split by its other blocks
DEEP_POINTS = 256  # points in a leaf of such a split
DEEP_ROWS = 1 << 22  # queries routed there at once
_VALUES = np.arange(1 << BLOCK, dtype=np.uint32)


def simhash(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a 64-bit fingerprint (long) of every row.

    Text with A-Z lower-cased, words split at ASCII white space; the shingles
    of ``shingle`` words, repeats included, are hashed by XXH64 with seed 42; a
    bit is set if set in over half of the hashes. Fewer words: one shingle of
    all of them; null or no words: fingerprint 0.
    """
    return _fingerprints(pick(docs, doc_id=id_col, text=text_col), shingle)


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``rows`` with the fingerprint ``fp`` in place of ``text``."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array((_fingerprint(t, shingle) for t in b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], fps], [*names, "fp"])

    return rows.mapInArrow(run, ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in names] + ["fp long"]))


def _fingerprint(text: str | None, shingle: int, at_once: int = 65_536) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, at_once):
        to = min(n, at + at_once)
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


class VantageTree:
    """A vantage-point tree over the values of one block, weighted by how many points have each value."""

    def __init__(self, weight: np.ndarray, leaf_points: int, radius: int):
        self.own = np.zeros(len(_VALUES), np.int32)  # value -> shard that stores it
        asks: list[tuple[np.ndarray, int]] = []  # (values whose balls overlap, shard)
        todo = [(_VALUES, _VALUES)]  # values inside the node, values whose balls overlap it
        leaf = 0
        while todo:
            inside, near = todo.pop()
            w = weight[inside]
            if w.sum() <= leaf_points or np.count_nonzero(w) <= 1:
                self.own[inside] = leaf
                asks.append((near, leaf))
                leaf += 1
                continue
            vantage, cut, d = self._vantage(inside, w)
            dn = np.bitwise_count(near ^ vantage)
            # |d(q, v) - d(x, v)| <= d(q, x): a ball that lies wholly on one side of the cut skips the other
            todo += [(inside[d <= cut], near[dn <= cut + radius]), (inside[d > cut], near[dn > cut - radius])]
        self.leaves = leaf
        values = np.concatenate([v for v, _ in asks])
        shards = np.concatenate([np.full(len(v), s, np.int32) for v, s in asks])
        order = np.argsort(values, kind="stable")
        self.asks = shards[order]
        self.first = np.searchsorted(values[order], np.arange(len(_VALUES) + 1))

    @staticmethod
    def _vantage(inside: np.ndarray, w: np.ndarray) -> tuple[np.uint32, int, np.ndarray]:
        """The candidate point and radius that halve the node's weight best."""
        best = None
        for v in inside[np.linspace(0, len(inside) - 1, min(8, len(inside))).astype(int)]:
            d = np.bitwise_count(inside ^ v)
            low = np.cumsum(np.bincount(d, weights=w, minlength=BLOCK + 1))
            cut = int(np.argmin(np.abs(low[:-1] - low[-1] / 2)))
            off = abs(low[cut] - low[-1] / 2)
            if 0 < low[cut] < low[-1] and (best is None or off < best[0]):
                best = (off, v, cut, d)
        if best is None:  # one point at distance 0 of itself, all others farther
            v = inside[np.argmax(w)]
            return v, 0, np.bitwise_count(inside ^ v)
        return best[1], best[2], best[3]


def links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all pairs within ``bits`` bits.

    Inside a shard only a spanning set of its links is kept: groups of
    near copies give rows in proportion to their size, not to its square.
    """
    spark: SparkSession = fps.sparkSession
    radius = bits // VIEWS
    block = lambda v: F.shiftrightunsigned("fp", BLOCK * v).bitwiseAND((1 << BLOCK) - 1).cast("int")
    views = fps.select("fp", F.posexplode(F.array(*[block(v) for v in range(VIEWS)])).alias("view", "value"))
    weight = np.zeros((VIEWS, 1 << BLOCK), np.int64)
    for r in views.groupBy("view", "value").count().collect():  # at most 4 x 65,536 rows, whatever the input
        weight[r["view"], r["value"]] = r["count"]
    trees = spark.sparkContext.broadcast([(t.own, t.asks, t.first) for t in (VantageTree(w, LEAF_POINTS, radius) for w in weight)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column("fp").to_numpy().view(np.uint64)
            parts = []
            for v, (own, asks, first) in enumerate(trees.value):
                value = ((u >> np.uint64(BLOCK * v)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
                n = first[value + 1] - first[value]
                at = np.repeat(first[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shard, home, fp = asks[at], np.repeat(own[value], n), np.repeat(u, n)
                # each of two linked points would ask the other's shard; the later shard is enough
                keep = shard >= home
                parts.append((shard[keep].astype(np.int64) * VIEWS + v, fp[keep], (shard == home)[keep]))
            shard, fp, stored = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((stored, shard))
            shard, fp, stored = shard[order], fp[order], stored[order]
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = np.append(first[1:], len(shard))
            n_asks = np.add.reduceat(~stored, first) if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first]), pa.array([fp[a:a + k].tobytes() for a, k in zip(first, n_asks)], pa.binary()),
                 pa.array([fp[a + k:z].tobytes() for a, k, z in zip(first, n_asks, ends)], pa.binary())], ["shard", "asks", "points"])

    def search(key: tuple, t: pa.Table) -> pa.Table:
        asks, points = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64) for c in ("asks", "points"))
        stored = np.arange(len(asks) + len(points)) >= len(asks)
        a, b = deep_links(np.concatenate([asks, points]), stored, bits, [v for v in range(VIEWS) if v != key[0].as_py() % VIEWS])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = fps.mapInArrow(route, "shard long, asks binary, points binary")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def deep_links(fp: np.ndarray, stored: np.ndarray, bits: int, views: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``shard_links`` of a shard of any size: a large one is split by trees over its other blocks.

    Of the three blocks left, one holds at most ``bits // 3`` of the differing
    bits, so a tree for each of them finds every pair again; its leaves go on
    with the blocks still left. Leaves of few pairs, or without blocks left,
    are compared.
    """
    if int(stored.sum()) * len(fp) <= DEEP_PAIRS or not views:
        return shard_links(fp, stored, bits)
    found = []
    for v in views:
        value = ((fp >> np.uint64(BLOCK * v)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
        weight = np.bincount(value[stored], minlength=1 << BLOCK)
        tree = VantageTree(weight, DEEP_POINTS, bits // len(views))
        n = tree.first[value + 1] - tree.first[value]
        ends = np.cumsum(n)
        rows_at_once = max(1, DEEP_ROWS // max(1, int(n.max())))
        points = np.flatnonzero(stored)
        points_leaf = tree.own[value[points]]
        by_leaf = points[np.argsort(points_leaf, kind="stable")]
        point_ends = np.searchsorted(np.sort(points_leaf), np.arange(tree.leaves + 1))
        for at in range(0, len(fp), rows_at_once):
            rows = np.arange(at, min(len(fp), at + rows_at_once))
            k = n[rows]
            leaf = tree.asks[np.repeat(tree.first[value[rows]] - (ends[rows] - k - (ends[at] - n[at])), k) + np.arange(k.sum())]
            row = np.repeat(rows, k)
            order = np.argsort(leaf, kind="stable")
            leaf, row = leaf[order], row[order]
            cut = np.flatnonzero(np.diff(leaf, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(leaf))):
                mine = by_leaf[point_ends[leaf[a]]:point_ends[leaf[a] + 1]]
                if len(mine):
                    both = np.concatenate([fp[row[a:b]], fp[mine]])
                    found.append(deep_links(both, np.arange(len(both)) >= b - a, bits, [w for w in views if w != v]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _spanning(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def shard_links(fp: np.ndarray, stored: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the shard's points and queries connect.

    A last vantage point prunes by the whole distance: only queries whose
    distance to it is within ``bits`` of a point's can link. Points already
    found linked to one centre are not compared with each other again.
    """
    points, asks = np.sort(fp[stored]), fp
    out_a, out_b = [], []
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    vantage = points[0]
    dp, dq = np.bitwise_count(points ^ vantage), np.bitwise_count(asks ^ vantage)
    order_p, order_q = np.argsort(dp, kind="stable"), np.argsort(dq, kind="stable")
    points, dp, asks, dq = points[order_p], dp[order_p].astype(np.int64), asks[order_q], dq[order_q].astype(np.int64)
    step = max(1, CHUNK * CHUNK // max(1, len(asks)))
    for at in range(0, len(points), step):
        p = points[at:at + step]
        lo = np.searchsorted(dq, dp[at] - bits)
        hi = np.searchsorted(dq, dp[min(len(points), at + step) - 1] + bits, side="right")
        i, j = np.nonzero(np.bitwise_count(p[:, None] ^ asks[None, lo:hi]) <= bits)
        a, b = p[i], asks[lo:hi][j]
        keep = a != b
        a, b = _spanning(a[keep], b[keep])
        out_a.append(a)
        out_b.append(b)
    return _spanning(np.concatenate(out_a), np.concatenate(out_b))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set of links with the same connected parts, one per fingerprint beside its part's smallest."""
    if not len(a):
        return a, b
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[:len(a)], code[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.arange(len(ids))
    linked = root != own
    return ids[root[linked]], ids[own[linked]]


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that can be reached by links of at most
    ``bits`` differing bits, the row's own included. Null ids: they link as any
    row but name no component, unless it has no other ids (null then). Repeated
    rows share a fingerprint and so a component. Texts without words all have
    fingerprint 0 and link. All shingles of a very long text count; they are
    hashed in blocks. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash")
    simhash(docs, shingle, id_col, text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _rooted(own, bits)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(own: DataFrame, bits: int) -> DataFrame:
    """A table of distinct fingerprints ``fp`` with the ``root`` of each one's group."""
    spark = own.sparkSession
    edges = scratch_path(spark, "simhash-links")
    links(own.select("fp"), bits).write.parquet(edges)
    part = components(spark.read.parquet(edges))  # node, root: only linked fingerprints
    return own.join(part, own["fp"] == part["node"], "left").select(*own.columns, F.coalesce("root", "fp").alias("root"))


def one_of_each_group(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of rows that links of at most ``bits`` differing bits connect; all columns stay as they are.

    The row with the smallest id stays, null ids last; of rows with one id the
    first by text key, then by a hash of the other columns. Rows are told
    apart by these, not by id alone: rows that repeat an id or have none are
    grouped by their texts as all others. Equal rows give one.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    other = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    k1, k2 = text_key(docs[text_col])
    keyed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), k1, k2, other.alias("other"),
                        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    path = scratch_path(spark, "simhash-rows")
    _fingerprints(keyed.drop("row"), shingle).write.parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "other")).alias("first")
    own = spark.read.parquet(path).groupBy("fp").agg(first)
    least = _rooted(own, bits).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    key = ["k1", "k2", "no_id", "id", "other"]
    told = lambda d: d.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    # equal rows collapse in each map task, then meet the rows to keep in the same partitions
    rows = told(keyed).select("row", *key).dropDuplicates(key)
    kept = rows.join(told(least).select(*key), key, "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
