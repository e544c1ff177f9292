"""Benchmark decontamination: rare seeds join passages to test items, Smith-Waterman alignment scores them.

An alignment that reaches the threshold matches a known share of the item's
words, so of the item's rarest words (by their count in all documents) some must be matched too: with ``u`` words that may stay unmatched,
``SEEDS`` of the rarest ``u + SEEDS``. Passages of the text that hold that many
in the reach of one alignment are joined to the item. No passing alignment
lacks them, whatever was edited, and words that are common anywhere are no
seeds. A passage is aligned unless its seeds, with all other words of the item,
or a match of each of its words that the item has, could not reach the
threshold. Alignment allows changed, added and dropped words. Words are
numbered; texts are searched and passages aligned many at a time.

The items are sent to all tasks in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import cover as C
from panelkit.llm.common import collect_bounded, pick, text_key

MIN_WORDS = 3
SEEDS = 6
BLOCK_BYTES = 4 << 20
MAX_BLOCK_ITEMS = 1_000_000
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
THRESHOLD = 0.5
LOSS = -max(GAP, MISMATCH)  # at least, for each word of the text that is not matched
BLOCK_WORDS = 1 << 15
CELLS = 1 << 14
UNKNOWN = -1

_FOLD = bytes.maketrans(bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)),
                        b" " * 32)  # ASCII punctuation separates words

FOUND = "doc_id {id}, k1 long, k2 long, item int, score double, start_word int, end_word int"


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def fold(text: str | None) -> np.ndarray:
    """Hashes of the words, in lower case and without ASCII punctuation."""
    raw = _folded(text)
    return C.spans(C.byte_symbols(raw), *C.word_bounds(raw))


def numbered(text: str | None, number: dict[bytes, int]) -> np.ndarray:
    """The words of ``fold`` by their numbers; other words are UNKNOWN."""
    words = _folded(text).split()
    return np.fromiter(map(number.get, words, repeat(UNKNOWN)), np.int32, len(words))


class Items:
    """Folded items with the score that each must reach, the reach of such an alignment, and the seeds.

    An alignment must score ``threshold`` of an unchanged copy, and as much as
    ``min_words`` matches. Its gains then bound its losses, and so the words
    of the text that it spans.
    """

    def __init__(self, texts: list[str], threshold: float, min_words: int):
        hashes = [fold(t) for t in texts]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, x).astype(np.int32) for x in hashes]
        self.number = {w: n for t, x in zip(texts, self.words) for w, n in zip(_folded(t).split(), x.tolist())}
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.least = np.maximum(threshold * MATCH * self.size, MATCH * min_words)
        self.span = self.size + np.ceil((MATCH * self.size - self.least) / -max(GAP, MISMATCH)).astype(np.int64)
        matched = np.ceil(self.least / MATCH).astype(np.int64)
        self.need = np.minimum(SEEDS, matched)
        self.n_seeds = np.where(matched <= self.size, self.size - matched + self.need, 0)  # none where the item is too short
        self.distinct = [np.unique(x, return_counts=True) for x in self.words]
        self.set_seeds(np.zeros(len(self.vocabulary), np.int64))

    def set_seeds(self, counts: np.ndarray) -> None:
        """Seeds of each item: its words with the smallest counts (in the order of ``vocabulary``), repeats of a word beside each other."""
        seed, item, others = [], [], []
        for i, (x, n) in enumerate(zip(self.words, self.n_seeds.tolist())):
            rare = x[np.lexsort((x, counts[x]))]
            seed.append(np.unique(rare[:n]))
            item.append(np.full(len(seed[-1]), i, np.min_scalar_type(len(self.words))))  # few bytes sort fast
            others.append(len(x) - int(np.isin(x, seed[-1]).sum()))
        seed, item = (np.concatenate(v) if v else np.zeros(0, np.int32) for v in (seed, item))
        self.others = np.array(others, np.int64)
        self.item = item[np.argsort(seed, kind="stable")]
        self.n_items = np.bincount(seed, minlength=len(counts) + 1)  # by word; the last one, UNKNOWN, has none
        self.first_item = np.cumsum(self.n_items) - self.n_items

    def passages(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, first word and end of the passages that together hold every passing alignment, of texts laid end to end.

        An alignment over ``length`` words with ``m`` matches scores at most
        (MATCH + LOSS) * m - LOSS * length, and ``m`` is at most its seeds and
        all words of the item that are none. Passages in which no run of seeds
        allows the threshold are left out.
        """
        n = self.n_items[x]
        at, n = np.flatnonzero(n), n[n > 0]
        k = self.item[_ranges(self.first_item[x[at]], self.first_item[x[at]] + n)]
        at = np.repeat(at, n)
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        text = np.searchsorted(starts, at, side="right") - 1
        j = np.arange(len(k)) + self.need[k] - 1
        i = np.flatnonzero(j < len(k))
        i = i[(k[j[i]] == k[i]) & (text[j[i]] == text[i]) & (at[j[i]] - at[i] < self.span[k[i]])]
        if not len(i):
            return (np.zeros(0, np.int64),) * 4
        value = (MATCH + LOSS) * np.arange(len(k)) - LOSS * at
        group = np.cumsum((np.diff(k, prepend=k[0]) != 0) | (np.diff(text, prepend=text[0]) != 0))
        shifted = value - group * (np.ptp(value) + 1.0)  # each group is below those before it
        most = shifted - np.minimum.accumulate(shifted) + MATCH  # of the runs of seeds that end here
        hot = (most >= self.least[k] - (MATCH + LOSS) * self.others[k])[j[i]]
        ends = np.append(starts[1:], len(x))
        k, text, start, end = k[i], text[i], at[j[i]] - self.span[k[i]] + 1, at[i] + self.span[k[i]]
        start, end = np.maximum(start, starts[text]), np.minimum(end, ends[text])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (text[1:] != text[:-1]) | (start[1:] > end[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(k)) - 1
        keep = np.logical_or.reduceat(hot, first)
        return text[first][keep], k[first][keep], start[first][keep], end[last][keep]

    def _found(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
        starts = np.cumsum([0] + [len(x) for x in texts[:-1]])
        places, pairs = [], []
        for i, k, start, end in zip(*[v.tolist() for v in self.passages(np.concatenate(texts), starts)]):
            start, end = start - int(starts[i]), end - int(starts[i])
            part = texts[i][start:end]
            if bound(*self.distinct[k], part) >= self.least[k]:
                places.append((i, k, start))
                pairs.append((self.words[k], part))
        got, ends = _best(pairs)
        passing = [p for p, (_, k, _) in enumerate(places) if got[p] >= self.least[k]]
        for p, first in zip(passing, _starts([pairs[p] for p in passing], got[passing], ends[passing])):
            i, k, start = places[p]
            yield i, k, float(got[p]) / (MATCH * len(self.words[k])), start + first, start + int(ends[p])

    def found(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """Number of the text, item, score, first word and end of the best alignment in each passage where one passes."""
        at, n, block = 0, 0, []
        for text in texts:
            block.append(numbered(text, self.number))
            n += len(block[-1])
            if n >= BLOCK_WORDS:
                yield from ((at + i, *hit) for i, *hit in self._found(block))
                at, n, block = at + len(block), 0, []
        if block:
            yield from ((at + i, *hit) for i, *hit in self._found(block))

    def scored(self, x: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """``found`` in one text, given by the hashes of its words."""
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, x), len(self.vocabulary) - 1)
            yield from (hit[1:] for hit in self._found([np.where(self.vocabulary[at] == x, at, UNKNOWN)]))


def bound(words: np.ndarray, times: np.ndarray, b: np.ndarray) -> float:
    """No alignment of an item, given by its distinct words, ascending, and how often it has each, within b scores more.

    No word is matched more often than the item or b has it; and each word of
    b that the item has is a match at best, the others a loss.
    """
    at = np.minimum(np.searchsorted(words, b), len(words) - 1)
    held = words[at] == b
    matched = MATCH * float(np.minimum(np.bincount(at[held], minlength=len(words)), times).sum())
    gain = np.where(held, MATCH, -LOSS).cumsum()
    low = np.minimum.accumulate(gain)
    return min(matched, float(max(gain.max(), (gain[1:] - low[:-1]).max(initial=0.0))))


def word_counts(d: DataFrame, block: Items) -> np.ndarray:
    """How often each word of the items occurs in all texts; each task sums its own first."""
    shared = d.sparkSession.sparkContext.broadcast(block.number)
    size = len(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)  # the last one is UNKNOWN
        for b in batches:
            for (text,) in C.rows(b, "text"):
                np.add.at(n, numbered(text, shared.value), 1)
        word = np.flatnonzero(n[:size])
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(n[word], pa.int64())], ["word", "n"])

    out = np.zeros(size, np.int64)
    if size:
        sums = d.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        for r in collect_bounded(sums, size, "words of the items"):
            out[r["word"]] = r["n"]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of words a (the item) within b: its score and where it starts and ends in b."""
    number = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    pair = [(number[:len(a)], number[len(a):])]
    score, end = _best(pair)
    return float(score[0]), _starts(pair, score, end)[0], int(end[0])


def _starts(pairs: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray, end: np.ndarray) -> list[int]:
    """Where the alignments that ``_best`` found start."""
    back, length = _best([(a[::-1], b[:e][::-1]) for (a, b), e in zip(pairs, end.tolist())])
    return np.where((back == score) & (score > 0), end - length, 0).tolist()


def _best(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Score of the best local alignment of each pair a, b of numbered words and where it ends in b; pairs of like length are aligned together."""
    score, end = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda p: len(pairs[p][1]))
    while order:
        width = len(pairs[order[-1]][1]) + 1
        part = order[-max(1, CELLS // width):]
        del order[-len(part):]
        score[part], end[part] = _best_of_block([pairs[p] for p in part], width)
    return score, end


def _best_of_block(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.float32 if width < CELLS else np.float64  # exact for scores and places of that size
    item = np.full((len(pairs), max(len(a) for a, _ in pairs)), UNKNOWN - 1, np.int32)
    text = np.full((len(pairs), width - 1), UNKNOWN, np.int32)
    for p, (a, b) in enumerate(pairs):
        item[p, :len(a)], text[p, :len(b)] = a, b
    hit, miss, gap = kind(MATCH - GAP), kind(MISMATCH - GAP), kind(GAP)
    ramp = np.arange(width, dtype=kind) * -gap  # added to all scores, so that a gap along b costs nothing
    row, new = np.tile(ramp, (len(pairs), 1)), np.tile(ramp, (len(pairs), 1))
    best, end, every = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64), np.arange(len(pairs))
    for w in range(item.shape[1]):
        cell = np.add(row[:, :-1], np.where(text == item[:, w:w + 1], hit, miss), out=new[:, 1:])
        np.maximum(cell, row[:, 1:] + gap, out=cell)
        np.maximum(cell, ramp[1:], out=cell)
        np.maximum.accumulate(new, axis=1, out=row)
        got = row - ramp
        j = got.argmax(axis=1)
        more = np.flatnonzero(got[every, j] > best)
        best[more], end[more] = got[more, j[more]], j[more]
    return best, end


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Contaminated documents: doc_id, item_id, score, start_word, end_word, with the text's key (k1, k2).

    score is the best local alignment of the whole item (2 a match, -1 a
    mismatch or gap) over that of an unchanged copy; rows below ``threshold``
    are not reported, nor those that score less than ``min_words`` words in a
    row would (this matters for items of fewer than twice as many words). All
    texts and items whose alignment passes are found. Words are compared in
    lower case without ASCII punctuation and counted from 0. One row per row
    id, text and item, its best place (the first of equals); repeated rows
    give one. Null and empty texts, and items of fewer than ``min_words``
    words, match nothing. A very long text is searched whole. Null ids
    are reported as null. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col)
    b = pick(items, item_id=item_col, text=item_text).where("text IS NOT NULL").withColumn("size", F.octet_length("text"))
    n_blocks = max(1, -(-(b.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))
    found = None
    for k in range(n_blocks):
        block = b.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == k).select("item_id", "text").orderBy("item_id", "text")
        part = _block(spark, d, collect_bounded(block, MAX_BLOCK_ITEMS, "items of a block"), items.schema[item_col].dataType.simpleString(),
                      threshold, min_words)
        found = part if found is None else found.unionByName(part)
    return found


def _block(spark, d: DataFrame, items: list, item_type: str, threshold: float, min_words: int) -> DataFrame:
    block = Items([r["text"] for r in items], threshold, min_words)
    block.set_seeds(word_counts(d, block))
    shared = spark.sparkContext.broadcast(block)
    schema = FOUND.format(id=d.schema["doc_id"].dataType.simpleString())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            found = list(shared.value.found(text for (text,) in C.rows(b, "text")))
            row, *cols = list(zip(*found)) or [[]] * 5
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(take) for c in ("doc_id", "k1", "k2")] +
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int32(), pa.int32()))], names)

    scored = d.select("doc_id", *text_key(F.col("text")), "text").mapInArrow(scan, schema)
    best = scored.groupBy("doc_id", "k1", "k2", "item").agg(
        F.max_by(F.struct("score", "start_word", "end_word"), F.struct(F.col("score"), -F.col("start_word"))).alias("b"))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {item_type}")
    return best.join(F.broadcast(names), "item").select("doc_id", "item_id", "b.*", "k1", "k2")  # as many rows as items in the block


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def without_matches(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text is in no match; all columns stay as they are."""
    keys = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = text_key(F.col(f"`{text_col}`"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("_k1"), k2.alias("_k2"))
    return row.join(keys, ["_k1", "_k2"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
