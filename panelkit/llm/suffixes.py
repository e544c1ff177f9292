"""Suffix-array dedup: every byte of a string of 200 bytes that starts in two places is removed.

The order of all suffixes is never built at once. Suffixes at difference-cover
positions are ranked first: equal ranks are equal hashes of the bytes that any
aligned pair of equal windows shares, and a cover suffix whose rank is its own
alone drops out. The others are resolved one bucket of equal ranks at a time.
A suffix's tie is settled by its neighbourhood, the bytes in which the windows
through it lie: equal neighbourhoods tie for all their windows, and what
remains is compared window by window inside its bucket, so memory holds one
bucket, not the corpus. Buckets with very many neighbourhoods are dealt by the
hash of the whole window instead, to any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import cover as C
from panelkit.llm.common import text_key

WINDOW = 200
PERIOD = 133
HOT = 20_000  # neighbourhoods in one bucket of equal ranks, above which it is dealt by windows
ROWS_AT_ONCE = 16_384

TIES = "k1 long, k2 long, iv array<int>, g long, s int, multi boolean"
AROUND = "g long, k1 long, k2 long, s int, n int, around binary"


class Shape:
    """Sizes that follow from the window and the cover's period."""

    def __init__(self, window: int, period: int):
        self.window, self.period = window, period
        self.core, self.side = window - period + 1, period - 1

    def rank(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """48 bits that name the core at s. They only choose a bucket: windows are compared by hashes of their own."""
        return C.windows(x, s, self.core) >> np.uint64(16)

    def sides(self, s: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the neighbourhood to the left of the cover position and to the right of its core."""
        return np.minimum(self.side, s), np.minimum(self.side, n - s - self.core)

    def starts(self, s: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The starts [lo, hi) of the text's windows that contain the core at s."""
        left, right = self.sides(s, n)
        return s - left, s - (self.side - right) + 1


def repeats(t: DataFrame, total: int, window: int = WINDOW, period: int = PERIOD, hot: int = HOT) -> DataFrame:
    """k1, k2, iv: starts [lo, hi) of all windows that start elsewhere too, from distinct texts ``t``."""
    z = Shape(window, period)
    density = len(C.difference_cover(period)) / period
    buckets = C.buckets_for(total * density)
    ranked = C.repeated_samples(t, buckets, C.byte_symbols, window, period)
    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = C.Packer(buckets, C.settle_all)
        for b in batches:
            for k1, k2, text, iv in C.rows(b, "k1", "k2", "text", "iv"):
                x = C.byte_symbols(text.encode("utf-8", "surrogatepass"))
                s = np.sort(np.array(iv, np.int64))
                left, right = z.sides(s, len(x))
                g = z.rank(x, s)
                whole = C.spans(x, s - left, s + z.core + right, 1)
                h = C.mix(whole ^ C.mix(g + left.astype(np.uint64)))
                yield from pack.add(k1, k2, len(x), h, s, g)
        yield from pack.flush()

    def tie(table: pa.Table) -> pa.Table:
        b = C.Bucket(table)
        at = np.flatnonzero(C.repeated(b, b.h))
        lo, hi = z.starts(b.pos[at].astype(np.int64), b.rank[b.text[at]])
        some = hi > lo
        sure = C.by_text(b, lo[some], hi[some], at[some])
        live = np.flatnonzero((b.flag & C.KNOWN) == 0)
        order, run = C.runs(b.h[live])
        first = np.flatnonzero(np.diff(run, prepend=-1))
        one = live[order[first]]
        multi = (np.bincount(run) > 1) | (np.bincount(run, weights=b.flag[live[order]]) > 0) if len(run) else np.zeros(0, bool)
        none = lambda n, kind: pa.nulls(n, kind)
        a = pa.table({"k1": sure["k1"], "k2": sure["k2"], "iv": sure["iv"], "g": none(len(sure), pa.int64()),
                      "s": none(len(sure), pa.int32()), "multi": none(len(sure), pa.bool_())})
        r = pa.table({"k1": b.k1[b.text[one]], "k2": b.k2[b.text[one]], "iv": none(len(one), pa.list_(pa.int32())),
                      "g": b.aux[one].view(np.int64), "s": b.pos[one].astype(np.int32), "multi": multi})
        return pa.concat_tables([a, r])

    ties = t.join(ranked, ["k1", "k2"]).mapInArrow(neighbourhoods, C.PACKED).groupBy("bucket").applyInArrow(tie, TIES)
    sure = ties.where("iv IS NOT NULL").select("k1", "k2", "iv")
    alone = ties.where("iv IS NULL").select("k1", "k2", "g", "s", "multi")
    # A bucket needs its windows compared if it has several neighbourhoods and one of them is not settled.
    open_ = alone.groupBy("g").agg(F.count(F.lit(1)).alias("n_around"), F.bool_and("multi").alias("settled")).where("n_around > 1 AND NOT settled")
    todo = alone.select("k1", "k2", "g", "s").join(open_.select("g", "n_around"), "g")
    per_text = todo.groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("n_around") <= hot, F.col("s"))).alias("some"),
        F.collect_list(F.when(F.col("n_around") > hot, F.col("s"))).alias("many"))
    work = t.join(per_text, ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in AROUND.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            for k1, k2, text, some in C.rows(b, "k1", "k2", "text", "some"):
                raw = text.encode("utf-8", "surrogatepass")
                s = np.sort(np.array(some, np.int64))
                left, right = z.sides(s, len(raw))
                g = z.rank(C.byte_symbols(raw), s).view(np.int64)
                out += [(int(gg), k1, k2, int(p), len(raw), raw[p - a:p + z.core + r])
                        for gg, p, a, r in zip(g, s.tolist(), left.tolist(), right.tolist())]
                if len(out) > ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("g")
        g = table["g"].to_numpy()
        parts, at = [], 0
        while at < len(g):
            to = min(len(g), at + ROWS_AT_ONCE)
            to = int(np.searchsorted(g, g[to - 1], side="right"))  # a bucket of equal ranks is not cut
            parts.append(_compare(table.slice(at, to - at), z))
            at = to
        return pa.concat_tables(parts)

    around = work.where(F.size("some") > 0).mapInArrow(cut, AROUND)
    some = around.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        lambda table: compare(table.drop_columns(["bucket"])), C.IV)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = C.Packer(buckets, C.settle_all)
        for b in batches:
            for k1, k2, text, many in C.rows(b, "k1", "k2", "text", "many"):
                x = C.byte_symbols(text.encode("utf-8", "surrogatepass"))
                lo, hi = z.starts(np.sort(np.array(many, np.int64)), len(x))
                _, lo, hi = C.merged(np.zeros(len(lo), np.int64), lo, np.maximum(lo, hi))
                p = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)])
                yield from pack.add(k1, k2, 0, C.windows(x, p, z.window), p)
        yield from pack.flush()

    def match(table: pa.Table) -> pa.Table:
        b = C.Bucket(table)
        at = np.flatnonzero(C.repeated(b, b.h))
        return C.by_text(b, b.pos[at], b.pos[at] + 1, at)

    many = work.where(F.size("many") > 0).mapInArrow(deal, C.PACKED).groupBy("bucket").applyInArrow(match, C.IV)
    return sure.unionByName(some).unionByName(many)


def _compare(t: pa.Table, z: Shape) -> pa.Table:
    """Windows that occur in several of the neighbourhoods of one rank; ranks stand together in ``t``."""
    g, s, n = (t[c].to_numpy() for c in ("g", "s", "n"))
    left, right = z.sides(s.astype(np.int64), n.astype(np.int64))
    width = z.side + z.core + z.side
    x = np.zeros((len(g), width), np.uint8)
    for i, (a, raw) in enumerate(zip(left.tolist(), t["around"].to_pylist())):
        x[i, z.side - a:z.side - a + len(raw)] = np.frombuffer(raw, np.uint8)
    up, down = C._powers(C._BASE[1], 1 << width.bit_length())
    sums = np.zeros((len(g), width + 1), np.uint64)
    np.cumsum(C._byte_codes()[x] * up[:width], axis=1, out=sums[:, 1:])
    bucket = C.mix(g.view(np.uint64))
    text, lo, hi = [], [], []
    for back in range(z.side + 1):
        valid = np.flatnonzero((back <= left) & (back >= z.side - right))
        if not len(valid):
            continue
        at = z.side - back
        h = C.mix((sums[valid, at + z.window] - sums[valid, at]) * down[at]) ^ bucket[valid]
        order, run = C.runs(h)
        hit = valid[order[np.bincount(run)[run] > 1]]
        text.append(hit)
        lo.append(s[hit].astype(np.int64) - back)
    if not text:
        return pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "iv": pa.array([], pa.list_(pa.int32()))})
    entry = _Entries(t["k1"].to_numpy(), t["k2"].to_numpy())
    at, lo = np.concatenate(text), np.concatenate(lo)
    return C.by_text(entry, lo, lo + 1, at)


class _Entries:
    """What by_text needs of a bucket, where each entry is its own row."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.k1, self.k2, self.text = k1, k2, np.arange(len(k1))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, hot: int = HOT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of ``window`` bytes of its own text that covers it
    also starts at any other place, in the same row or another; matches never
    cross rows and are judged on the input. Null and empty texts have no bytes.
    Repeated rows, whatever their ids, are repeats of each other. Null ids keep
    their rows. A very long text is searched whole, by one task at a time. An
    empty table gives an empty result.
    """
    done = _distinct_texts(docs, window, period, hot, id_col, text_col, keep=False).drop("kept_text")
    return C.keyed(docs, id_col, text_col).join(done, ["k1", "k2"]).drop("k1", "k2")


def suffix_dedup_rows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, hot: int = HOT, id_col: str = "doc_id",
                      text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut out of their texts and ``size_col``, if there is one, counted anew.

    As ``suffix_dedup`` decides. A cut inside a character leaves a replacement
    character. Null texts stay null; texts cut to nothing stay as empty ones.
    """
    done = _distinct_texts(docs, window, period, hot, id_col, text_col, keep=True)
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    keyed = docs.select(other, F.col(f"`{text_col}`").isNull().alias("no_text"), *text_key(F.col(f"`{text_col}`")))
    out = keyed.join(done.select("k1", "k2", "kept_text"), ["k1", "k2"])
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    cols = {c: F.col("row").getField(c) for c in docs.columns if c != text_col} | {text_col: text}
    if size_col in docs.columns:
        cols[size_col] = F.length(text).cast(docs.schema[size_col].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])


def _distinct_texts(docs: DataFrame, window: int, period: int, hot: int, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """One row per distinct text: k1, k2, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless ``keep``)."""
    t = C.texts(docs, id_col, text_col)
    found = C.gather(repeats(t, C.total_bytes(docs, text_col), window, period, hot))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            out = [_result(*r, window, keep) for r in C.rows(b, "text", "n", "iv")]
            own = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *own], names)

    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    return t.join(found, ["k1", "k2"], "left").mapInArrow(
        finish, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def _result(text: str, n: int, iv: list[int] | None, window: int, keep: bool) -> tuple[int, int, int, str, str | None]:
    raw = text.encode("utf-8", "surrogatepass")
    if n > 1 and len(raw) >= window:
        lo, hi = np.array([0]), np.array([len(raw)])
    else:
        lo, hi = C.grow(*C.union(iv), window)
    edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:z] for a, z in zip(edges[0::2], edges[1::2]))
    return len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep else None
