"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad, with features of the line and of its two
neighbours and with a score for each pair of successive labels. Forward-backward
gives each line's probability to be good; their mean, weighted by line length,
is the document's share of good text, which a logistic curve turns into the
probability of quality label 1.

The field is fitted on at most about ``SAMPLE`` labelled documents, chosen by
hash. Only documents are labelled, so line labels are found in rounds: all lines
start with their document's label, then lines of bad documents that the model
takes for good are relabelled, and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import held_out, pick
from panelkit.llm.cover import rows

SAMPLE = 4_000
MAX_SAMPLE_LINES = 2_000_000
ROUNDS = 3
STEPS = 120
RATE = 0.15
DECAY = 1e-4
CELLS = 1 << 20  # lines x documents labelled at once
N_FEATURES = 13

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))


def line_features(lines: list[bytes], at: int = 0, to: int | None = None) -> np.ndarray:
    """Features of lines [at, to) with those of their neighbours: lines x (3 N_FEATURES + 1)."""
    to = len(lines) if to is None else min(to, len(lines))
    own = np.zeros((to - at + 2, N_FEATURES), np.float32)
    for i in range(at - 1, to + 1):
        if 0 <= i < len(lines):
            own[i - at + 1] = _line(lines[i], lines[i - 1] if i else None)
        else:
            own[i - at + 1, -1] = 1  # beyond the text
    return np.concatenate([own[1:-1], own[:-2], own[2:], np.ones((to - at, 1), np.float32)], axis=1)


def split_lines(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The lines and their weights."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, np.fromiter((max(1, len(x)) for x in lines), np.float64, len(lines))


def line_scores(lines: list[bytes], weights: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The score of good against bad of each line; features are made for ``step`` lines at a time."""
    return np.concatenate([line_features(lines, at, at + step) @ weights for at in range(0, len(lines), step)])


def _line(line: bytes, previous: bytes | None) -> tuple[float, ...]:
    words = line.split()
    n, size = len(words), max(1, len(line))
    if not n:
        return (0.0,) * (N_FEATURES - 2) + (1.0, 0.0)
    share = lambda k, of, full: min(1.0, k / of / full)  # noqa: E731  1 from ``full`` on
    less = lambda chars: len(line) - len(line.translate(None, chars))
    return (
        share(less(_SYMBOLS), size, 0.1), share(less(_UPPER), size, 0.4), share(line.count(b"!"), n, 0.5),
        share(line.count(b"|"), n, 0.3), 1 - len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        float(words[-1][-1:] in b".?!"), share(size, n, 20.0), share(less(_DIGITS), size, 0.5),
        min(1.0, n / 50), float(line == previous), 0.0, 0.0)


@dataclass
class Field:
    weights: np.ndarray  # good against bad, per feature
    pairs: np.ndarray  # 2 x 2: score of a label after a label (0 bad, 1 good)
    slope: float
    offset: float


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in parts])
    out = np.zeros((n.max(), len(parts)))
    for i, p in enumerate(parts):
        out[:len(p), i] = p
    return out, n


def forward_backward(unary: np.ndarray, n: np.ndarray, pairs: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """P(good) for each line (lines x documents), and with ``expect`` the expected counts of label pairs.

    unary: the score of good against bad, padded below each document's ``n`` lines.
    """
    t, d = unary.shape
    f, b = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    f[0, :, 1] = unary[0]
    lse = np.logaddexp
    for i in range(1, t):
        for y in (0, 1):
            f[i, :, y] = lse(f[i - 1, :, 0] + pairs[0, y], f[i - 1, :, 1] + pairs[1, y])
        f[i, :, 1] += unary[i]
    for i in range(t - 2, -1, -1):
        live = i + 1 < n
        for y in (0, 1):
            b[i, :, y] = np.where(live, lse(pairs[y, 0] + b[i + 1, :, 0], pairs[y, 1] + unary[i + 1] + b[i + 1, :, 1]), 0.0)
    total = f + b
    p = 1 / (1 + np.exp(np.clip(total[:, :, 0] - total[:, :, 1], -500, 500)))
    counts = np.zeros((2, 2))
    if expect and t > 1:
        z = lse(total[0, :, 0], total[0, :, 1])
        live = np.arange(1, t)[:, None] < n
        for y in (0, 1):
            for y2 in (0, 1):
                s = f[:-1, :, y] + pairs[y, y2] + (unary[1:] if y2 else 0.0) + b[1:, :, y2] - z
                counts[y, y2] = np.exp(np.clip(s, -500, 50))[live].sum()
    return p, counts


def groups(n: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of similar length together, at most CELLS padded lines in a group."""
    order = np.argsort(n, kind="stable")[::-1]
    at = 0
    while at < len(order):
        k = max(1, CELLS // max(1, int(n[order[at]])))
        # within a factor of 4 of the longest, so padding stays small
        short = int(np.searchsorted(-n[order], -max(1, int(n[order[at]]) // 4), side="right"))
        to = min(len(order), at + k, max(at + 1, short))
        yield order[at:to]
        at = to


def fit(x: list[np.ndarray], weight: list[np.ndarray], label: np.ndarray) -> Field:
    """Fit on documents: line features, line weights and document labels."""
    n = np.array([len(p) for p in x])
    size = x[0].shape[1] if x else 3 * N_FEATURES + 1
    field = Field(np.zeros(size), np.zeros((2, 2)), 6.0, -2.0)
    if not len(x) or label.min() == label.max():
        return Field(field.weights, field.pairs, 0.0, 4.0 if len(x) and label.min() == 1 else 0.0)
    y = [np.full(len(p), float(v)) for p, v in zip(x, label)]
    parts = [(g, np.concatenate([x[i] for i in g])) for g in groups(n)]
    for turn in range(ROUNDS):
        _climb(field, parts, y, n)
        if turn + 1 < ROUNDS:
            for i, p in zip(*_label_all(field, parts, n)):
                if not label[i]:
                    y[i] = (p > 0.5).astype(float)
                    y[i][np.argmin(p)] = 0.0
    ids, p = _label_all(field, parts, n)
    share = np.zeros(len(x))
    for i, q in zip(ids, p):
        share[i] = (q * weight[i]).sum() / weight[i].sum()
    for _ in range(300):  # logistic curve of the share of good text, by Newton's steps with a weak prior
        s = 1 / (1 + np.exp(-(field.slope * share + field.offset)))
        v = s * (1 - s)
        grad = np.array([((label - s) * share).sum() - 0.05 * (field.slope - 6), (label - s).sum() - 0.05 * (field.offset + 2)])
        hess = np.array([[(v * share * share).sum() + 0.05, (v * share).sum()], [(v * share).sum(), v.sum() + 0.05]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        field.slope, field.offset = field.slope + step[0], field.offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return field


def _label_all(field: Field, parts: list, n: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    ids, out = [], []
    for g, features in parts:
        u, _ = _padded(np.split(features @ field.weights, np.cumsum(n[g])[:-1]))
        p, _ = forward_backward(u, n[g], field.pairs)
        ids += g.tolist()
        out += [p[:k, j] for j, k in enumerate(n[g])]
    return ids, out


def _climb(field: Field, parts: list, y: list[np.ndarray], n: np.ndarray) -> None:
    """Adam steps on the likelihood of the line labels; documents count alike, whatever their length."""
    theta = np.concatenate([field.weights, field.pairs.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for line in y:
        k = line.astype(int)
        np.add.at(seen, (k[:-1], k[1:]), 1.0)
    truth = [np.concatenate([y[i] for i in g]) for g, _ in parts]
    lines = float(n.sum())
    for step in range(1, STEPS + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        grad, expected = np.zeros_like(w), np.zeros((2, 2))
        for (g, features), t in zip(parts, truth):
            u, _ = _padded(np.split(features @ w, np.cumsum(n[g])[:-1]))
            p, c = forward_backward(u, n[g], pairs, expect=True)
            got = np.concatenate([p[:k, j] for j, k in enumerate(n[g])])
            grad += features.T @ (t - got)
            expected += c
        full = np.concatenate([grad, (seen - expected).ravel()]) / lines - DECAY * theta
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    field.weights, field.pairs = theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality") -> Field:
    """Fit on labelled rows that are not held out: about ``sample`` of them by hash, whole texts.

    Only line features reach the driver; more than MAX_SAMPLE_LINES lines in
    the sample raise an error. Null labels and ids do not train.
    """
    d = pick(docs, doc_id=id_col, text=text_col).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = pick(labels, doc_id=label_id, label=label_col).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(
        F.max("label").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / float(1 << 53)
    chosen = known.where(place < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for label, text in rows(b, "label", "text"):
                lines, w = split_lines(text)
                x = line_features(lines)
                out.append((label, len(w), x.tobytes(), w.tobytes()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                             ["label", "n", "x", "w"])

    # the chosen ids are about ``sample`` rows by construction, so they go to the texts and not the other way round
    got = d.where(place < share).join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(
        features, "label int, n int, x binary, w binary")
    found, lines = [], 0
    for r in got.toLocalIterator():
        lines += r["n"]
        if lines > MAX_SAMPLE_LINES:
            raise ValueError(f"the training sample has more than {MAX_SAMPLE_LINES} lines; lower sample")
        found.append((r["label"], np.frombuffer(r["x"], np.float32).reshape(r["n"], -1), np.frombuffer(r["w"], np.float64)))
    found.sort(key=lambda r: (r[0], len(r[2]), r[1].tobytes()))  # the same field whatever the order of rows
    return fit([r[1] for r in found], [r[2] for r in found], np.array([float(r[0] > 0) for r in found]))


def quality(docs: DataFrame, field: Field, accept: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
            carry: bool = False) -> DataFrame:
    """doc_id, score, predicted (1 if score >= accept) and good_share of every row.

    With ``carry``, a struct column ``row`` holds all columns of the input.
    A null text is scored as the empty text, one blank line. Null and repeated
    ids keep their rows. Very long texts are labelled as a whole. An empty
    table gives an empty result; without labels of both kinds every row gets
    the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.pairs, field.slope, field.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs, slope, offset = shared.value
        for b in batches:
            shares: list[float] = []
            for at in range(0, b.num_rows, 256):
                made = [split_lines(t) for t in b.column("text").slice(at, 256).to_pylist()]
                unary, n = [line_scores(x, weights) for x, _ in made], np.array([len(w) for _, w in made])
                part = np.zeros(len(made))
                for g in groups(n):
                    u, k = _padded([unary[i] for i in g])
                    p, _ = forward_backward(u, k, pairs)
                    for j, i in enumerate(g):
                        w = made[i][1]
                        part[i] = (p[:len(w), j] * w).sum() / w.sum()
                shares += part.tolist()
            share = np.array(shares)
            score = 1 / (1 + np.exp(-(slope * share + offset)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(score), pa.array(share)], [*kept, "score", "good_share"])

    kept = ["doc_id"] + ["row"] * carry
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *row)
    schema = T.StructType([d.schema[c] for c in kept]).add("score", "double").add("good_share", "double")
    out = d.mapInArrow(run, schema)
    return out.select(*kept, "score", (F.col("score") >= accept).cast("int").alias("predicted"), "good_share")
