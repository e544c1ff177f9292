"""Substring dedup: every window of words that starts in a document with a smaller id is removed.

Cover positions of each text are hashed over the part of a window that any
aligned pair shares. Where such a hash occurs again, the windows around it are
the candidates: each anchor is extended to all windows that contain it, and
their whole word sequences are compared, again bucket by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import cover as C

WINDOW = 50
PERIOD = 31
MEAN_WORD = 6.0
_LAST = (1 << 63) - 1  # null ids come after all others


def word_symbols(text: bytes) -> np.ndarray:
    lo, hi = C.word_bounds(text)
    return C.spans(C.byte_symbols(text), lo, hi)


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text",
                    keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and kept_text, the kept words joined by a space).

    A word goes if a window of ``window`` words that covers it also starts in
    a row with a smaller id; windows are judged on the input. Equal ids are
    not smaller; null ids count as larger than all others and equal among
    themselves. Null, empty and short texts keep their words. Repeated rows
    with one id are alike. An empty table gives an empty result.
    """
    buckets = C.buckets_for(C.total_bytes(docs, text_col) / MEAN_WORD * 0.2)
    t = C.texts(docs, id_col, text_col).withColumn("rank", F.coalesce(F.col("least").cast("long"), F.lit(_LAST)))
    width = window - period + 1
    anchors = C.repeated_samples(t, buckets, word_symbols, window, period)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = C.Packer(buckets, settle_smaller)
        for b in batches:
            for k1, k2, rank, text, iv in C.rows(b, "k1", "k2", "rank", "text", "iv"):
                x = word_symbols(text.encode("utf-8", "surrogatepass"))
                s = np.sort(np.array(iv, np.int64))
                lo, hi = np.maximum(s - (window - width), 0), np.minimum(s + 1, len(x) - window + 1)
                _, lo, hi = C.merged(np.zeros(len(lo), np.int64), lo, np.maximum(hi, lo))
                p = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi)] or [np.zeros(0, np.int64)])
                if len(p):
                    yield from pack.add(k1, k2, rank, C.windows(x, p, window), p, C.windows(x, p, window, 1))
        yield from pack.flush()

    def decide(table: pa.Table) -> pa.Table:
        b = C.Bucket(table)
        live = np.flatnonzero((b.flag & C.KNOWN) == 0)
        order, run = C.runs(b.h[live], b.aux[live])
        rank = b.rank[b.text[live[order]]]
        least = np.minimum.reduceat(rank, np.flatnonzero(np.diff(run, prepend=-1))) if len(run) else rank
        out = np.flatnonzero(b.flag & C.KNOWN)
        at = np.concatenate([out, live[order[rank > least[run]]] if len(run) else out[:0]])
        return C.by_text(b, b.pos[at], b.pos[at] + 1, at)

    packed = t.join(anchors, ["k1", "k2"]).mapInArrow(candidates, C.PACKED)
    found = C.gather(packed.groupBy("bucket").applyInArrow(decide, C.IV))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_result(*r, window, keep_text) for r in C.rows(b, "text", "iv")]
            cols = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            own = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("rank"), *own], names)

    names = ["k1", "k2", "rank", "n_words", "removed", "sha", "kept"]
    done = t.join(found, ["k1", "k2"], "left").mapInArrow(
        finish, "k1 long, k2 long, rank long, n_words long, removed long, sha string, kept string")
    rows = C.keyed(docs, id_col, text_col).join(done, ["k1", "k2"])
    # A row with a larger id than another row with its text has all its windows there.
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) > F.col("rank")) & (F.col("n_words") >= window)
    out = [F.col("doc_id"), F.col("n_words"), F.when(copy, F.col("n_words")).otherwise(F.col("removed")).alias("n_removed"),
           F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha")).alias("kept_sha256")]
    return rows.select(*out, *[F.when(copy, "").otherwise(F.col("kept")).alias("kept_text")] * keep_text)


def settle_smaller(h: np.ndarray, text: np.ndarray, aux: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries beside one of smaller rank are settled; of those with the smallest rank all travel."""
    order, run = C.runs(h, aux)
    own = rank[text[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(np.diff(run, prepend=-1)))
    flag = np.zeros(len(h), np.uint8)
    flag[order[own > least[run]]] = C.KNOWN
    return np.arange(len(h)), flag


def _result(text: str, iv: list[int] | None, window: int, keep_text: bool) -> tuple[int, int, str, str | None]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    keep = np.ones(n, bool)
    lo, hi = C.grow(*C.union(iv), window)
    for a, z in zip(lo, hi):
        keep[a:z] = False
    kept = b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])
    return n, int(n - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None
