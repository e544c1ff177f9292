"""Repeats found at difference-cover positions: hashing, and matching of packed entries bucket by bucket.

A difference cover modulo v is a set of residues whose pairwise differences
give every residue. For any two positions there is then a shift below v that
brings both to cover positions, whatever their distance: two equal windows of
W symbols share a pair of aligned cover positions that are followed by
W - v + 1 equal symbols. Only cover positions are hashed and moved.

Entries (hash, text, position, ...) travel as packed arrays, one row per task
block and bucket of hashes. A block first settles what it can by itself and
sends one entry per hash, so a bucket holds at most a few entries per block
for one hash, however many texts share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import pick, text_key

PIECE = 1 << 17  # symbols hashed at once
BLOCK_ENTRIES = 2_000_000
BUCKET_ENTRIES = 5_000_000
LEAST_BUCKETS = 16
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def memo(f: Callable) -> Callable:
    """Keeps results by arguments; a plain function, so that it travels to the executors by value."""
    kept: dict = {}

    def of(*args):
        if args not in kept:
            kept[args] = f(*args)
        return kept[args]

    return of


@memo
def difference_cover(v: int) -> tuple[int, ...]:
    """A perfect difference cover modulo v = q*q + q + 1, q prime: q + 1 residues.

    Singer's construction: the powers of a generator x of the field of q**3
    elements, modulo v, that lie in a plane.
    """
    q = next((k for k in range(2, v) if k * k + k + 1 == v), 0)
    if not q or any(q % k == 0 for k in range(2, q)):
        raise ValueError(f"{v} is not q*q + q + 1 of a prime q")
    for c in range(q ** 3):  # x**3 = c0 + c1 x + c2 x**2; most choices generate
        c0, c1, c2 = c % q, c // q % q, c // q // q
        p, found = (1, 0, 0), []
        for i in range(v):
            if p[2] == 0:
                found.append(i)
            p = (p[2] * c0 % q, (p[0] + p[2] * c1) % q, (p[1] + p[2] * c2) % q)
        if len(found) == q + 1 and len({(a - b) % v for a in found for b in found}) == v:
            return tuple(found)
    raise ValueError(f"no generator for {v}")


def cover_positions(n: int, v: int) -> np.ndarray:
    """The cover positions below n."""
    d = np.array(difference_cover(v), np.int64)
    s = (np.arange(0, n, v, dtype=np.int64)[:, None] + d).ravel()
    return s[s < n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@memo
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        x = np.full(n, b, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return up(base), up(pow(base, -1, 1 << 64))


@memo
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def spans(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of x[start:end]; starts ascend. Bytes are coded, other symbols taken as they are.

    A polynomial hash from prefix sums; each span is shifted back to power 0,
    so equal spans have equal hashes wherever they stand. Long inputs are
    hashed piece by piece.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + PIECE)))
        hi = int(ends[at:to].max())
        part = x[lo:hi]
        part = _byte_codes()[part] if part.dtype == np.uint8 else part
        size = 1 << max(10, int(hi - lo).bit_length())
        up, down = _powers(_BASE[which], size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(part * up[:hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix(((sums[e] - sums[s]) * down[s]) ^ (e - s).astype(np.uint64))
        at = to
    return out


def windows(x: np.ndarray, starts: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    return spans(x, starts, starts + width, which)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space)."""
    gap = np.concatenate([[True], _SPACE[np.frombuffer(text, np.uint8)], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: its key (k1, k2), the text, how many rows have it and their smallest id.

    Users read all its columns each time, so that one shuffle of the texts
    serves all of them.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    return d.select(*text_key(F.col("text")), "doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("k1", "k2").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text key of every row."""
    d = pick(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", *text_key(F.col("text")))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.select(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0


def buckets_for(entries: float) -> int:
    """A power of two of buckets with about BUCKET_ENTRIES entries each."""
    return 1 << max(LEAST_BUCKETS - 1, int(entries / BUCKET_ENTRIES)).bit_length()


PACKED = "bucket int, k1 binary, k2 binary, rank binary, h binary, text binary, pos binary, aux binary, flag binary"
KNOWN, MULTI = 1, 2  # flags: settled in its block, only passes through; stands for several entries of its block


class Packer:
    """Collects entries of consecutive texts and packs them by bucket.

    ``short``: of a hash, only the bucket and 32 bits travel, which is enough
    where equality is checked again later.
    """

    def __init__(self, buckets: int, settle: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
                 short: bool = False):
        self.buckets, self.settle, self.short = buckets, settle, short
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self._clear()

    def _clear(self) -> None:
        self.k1, self.k2, self.rank, self.parts, self.n = [], [], [], [], 0

    def add(self, k1: int, k2: int, rank: int, h: np.ndarray, pos: np.ndarray, aux: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``rank``: an order among texts; ``aux``: 64 further bits of each entry."""
        self.parts.append((h, np.full(len(h), len(self.k1), np.uint32), pos.astype(np.uint32),
                           np.zeros(len(h), np.uint64) if aux is None else aux))
        self.k1.append(k1)
        self.k2.append(k2)
        self.rank.append(rank)
        self.n += len(h)
        if self.n >= BLOCK_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, text, pos, aux = (np.concatenate(x) for x in zip(*self.parts))
        k1, k2, rank = np.array(self.k1, np.int64), np.array(self.k2, np.uint32), np.array(self.rank, np.int64)
        self._clear()
        keep, flag = self.settle(h, text, aux, rank)  # which entries travel, and their flags
        h, text, pos, aux, flag = h[keep], text[keep], pos[keep], aux[keep], flag[keep]
        bucket = (h >> self.shift).astype(np.int64)
        # Settled entries may go anywhere: they are spread by text, so that a hash with many of them fills no bucket.
        known = (flag & KNOWN) > 0
        bucket[known] = (mix(k1[text[known]].view(np.uint64)) >> self.shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows: list[tuple] = []
        for b in range(self.buckets):
            i = order[edges[b]:edges[b + 1]]
            if len(i):
                own, local = np.unique(text[i], return_inverse=True)
                has_aux = aux[i].any()
                name = h[i].astype(np.uint32) if self.short else h[i]
                rows.append((b, k1[own].tobytes(), k2[own].tobytes(), rank[own].tobytes(), name.tobytes(), _planes(local.astype(np.uint32)),
                             _planes(pos[i]), _planes(aux[i]) if has_aux else b"", flag[i].tobytes() if flag[i].any() else b""))
        names = [x.split()[0] for x in PACKED.split(", ")]
        types = [pa.int32()] + [pa.binary()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which the shuffle's compression makes small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(b: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Bucket:
    """The unpacked entries of a bucket: h, text (index into k1, k2, rank), pos, aux, flag."""

    def __init__(self, t: pa.Table, short: bool = False):
        col = {n: [x.as_buffer() for x in t.column(n)] for n in t.column_names if n != "bucket"}  # views, not copies
        ints = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in col[c]])
        self.k1, self.k2, self.rank = ints("k1", np.int64), ints("k2", np.uint32).astype(np.int64), ints("rank", np.int64)
        self.h = ints("h", np.uint32 if short else np.uint64)
        n = [len(x) // 4 for x in col["text"]]
        base = np.cumsum([0] + [len(x) // 8 for x in col["k1"]])
        self.text = np.concatenate([_unplanes(x).view(np.int32) + np.int32(b) for x, b in zip(col["text"], base)])
        self.pos = np.concatenate([_unplanes(x).view(np.int32) for x in col["pos"]])
        with_aux = any(len(x) for x in col["aux"])
        self.aux = np.concatenate([_unplanes(x, np.uint64) if len(x) else np.zeros(k * with_aux, np.uint64) for x, k in zip(col["aux"], n)])
        self.flag = np.concatenate([np.frombuffer(x, np.uint8) if len(x) else np.zeros(k, np.uint8) for x, k in zip(col["flag"], n)])


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the number of each entry's run in that order."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new, dtype=np.int32) - 1


def by_text(b: Bucket, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> pa.Table:
    """Intervals [lo, hi) of the texts of entries ``at``: one row per text, joined where they touch."""
    text, lo, hi = (x.astype(np.int64) for x in (b.text[at], lo, hi))
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    if not len(text):
        return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "iv": pa.array([], pa.list_(pa.int32()))})
    text, lo, hi = merged(text, lo, hi)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    pairs = np.stack([lo, hi], axis=1).ravel().astype(np.int32)
    offsets = np.concatenate([first, [len(text)]]) * 2
    return pa.table({"k1": pa.array(b.k1[text[first]]), "k2": pa.array(b.k2[text[first]]),
                     "iv": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs, pa.int32()))})


def points_by_text(b: Bucket, at: np.ndarray) -> pa.Table:
    """The positions of entries ``at``: one row per text."""
    order = np.lexsort((b.pos[at], b.text[at]))
    text, pos = b.text[at][order], b.pos[at][order]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    offsets = np.append(first, len(text)) if len(text) else np.zeros(1)
    return pa.table({"k1": pa.array(b.k1[text[first]]), "k2": pa.array(b.k2[text[first]]),
                     "iv": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pos, pa.int32()))})


def merged(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals sorted by (text, lo), with those that overlap or touch made one."""
    width = int(hi.max()) + 1 if len(hi) else 1
    a, z = text * width + lo, text * width + hi
    reach = np.maximum.accumulate(z)
    new = np.concatenate([[True], a[1:] > reach[:-1]]) if len(a) else np.zeros(0, bool)
    i = np.flatnonzero(new)
    if not len(i):
        return text[:0], lo[:0], hi[:0]
    last = np.concatenate([i[1:] - 1, [len(a) - 1]])
    return text[i], lo[i], reach[last] - text[i] * width


IV = "k1 long, k2 long, iv array<int>"


def gather(iv: DataFrame) -> DataFrame:
    """All intervals of a text in one row; their number is bounded by the text's length."""
    return iv.groupBy("k1", "k2").agg(F.flatten(F.collect_list("iv")).alias("iv"))


def union(iv: list[int] | np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(iv if iv is not None else [], np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    _, lo, hi = merged(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
    return lo, hi


def grow(lo: np.ndarray, hi: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts [lo, hi) to the symbols those windows of ``by`` symbols cover."""
    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi + by - 1)
    return lo, hi


def settle_all(h: np.ndarray, text: np.ndarray, aux: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with equal hashes, the first travels for all; the others are known to be repeats."""
    order, run = runs(h)
    first = np.concatenate([[True], run[1:] != run[:-1]])
    many = np.bincount(run)[run] > 1
    flag = np.zeros(len(h), np.uint8)
    flag[order[first & many]] = MULTI
    flag[order[~first]] = KNOWN
    return np.arange(len(h)), flag


def repeated(b: Bucket, key: np.ndarray) -> np.ndarray:
    """Which entries are repeats: settled before, standing for several, or with the key of another entry."""
    out = b.flag > 0
    live = np.flatnonzero((b.flag & KNOWN) == 0).astype(np.int32)
    key = key[live]
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    del key
    out[live[order[same[1:] | same[:-1]]]] = True
    return out


def repeated_samples(t: DataFrame, buckets: int, symbols: Callable[[bytes], np.ndarray], window: int, v: int) -> DataFrame:
    """k1, k2, iv: the cover positions whose next window - v + 1 symbols occur elsewhere too (a list of positions)."""
    width = window - v + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(buckets, settle_all, short=True)
        for b in batches:
            for k1, k2, text in rows(b, "k1", "k2", "text"):
                x = symbols(text.encode("utf-8", "surrogatepass"))
                if len(x) >= window:
                    s = cover_positions(len(x) - width + 1, v)
                    yield from pack.add(k1, k2, 0, windows(x, s, width), s)
        yield from pack.flush()

    def match(table: pa.Table) -> pa.Table:
        b = Bucket(table, short=True)
        return points_by_text(b, np.flatnonzero(repeated(b, b.h)))

    return gather(t.mapInArrow(sample, PACKED).groupBy("bucket").applyInArrow(match, IV))


def rows(b: pa.RecordBatch, *names: str, step: int = 64) -> Iterator[tuple]:
    """Python values of a batch, a few rows at a time."""
    for at in range(0, b.num_rows, step):
        part = b.slice(at, step)
        yield from zip(*[part.column(n).to_pylist() for n in names])
