"""Periodic runs by recompression: a run-length grammar answers how far two places agree.

Words of a block of documents become symbols. Rounds of block compression
(equal neighbours become one symbol with a repeat count) and pair compression
(a left symbol and a right symbol become one; the sides are drawn anew each
round) shrink every document to one symbol. Equal stretches get equal symbols
wherever they stand, except near their ends, so two places are compared by
climbing the levels of the grammar while they agree and descending to the
first difference: a few steps a level, for all questions at once.

A run of period q with four or more periods covers three whole steps of the
grid of multiples of q, so only places of that grid whose words agree over
three steps are candidates; the grammar extends each to both sides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import WORD, pick

BLOCK_WORDS = 200_000  # words of documents handled together; a longer text is a block of its own
PERIODS = 4  # whole periods that a run holds at least
LEAST = 6  # words that a run holds at least
STEP = 2_000_000  # candidates tested at a time


class Level:
    """One string of the grammar and the way up to the next."""

    __slots__ = ("symbols", "blocks", "parent", "first", "child")

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols

    def close(self, starts: np.ndarray, blocks: bool) -> None:
        """``starts``: True where a symbol of the next level begins; ``blocks``: its children are equal symbols."""
        self.blocks, self.first = blocks, np.append(starts, True)
        self.parent = np.append(np.cumsum(starts) - 1, starts.sum()).astype(np.int32)
        self.child = np.append(np.flatnonzero(starts), len(starts)).astype(np.int32)


class Grammar:
    """Levels of a concatenation of texts; ``text`` ends each document with a symbol of its own (below 0)."""

    def __init__(self, text: np.ndarray):
        self.levels: list[Level] = []
        rng = np.random.default_rng(12)
        s, free = text, int(text.max(initial=-1)) + 1
        while True:
            level = Level(s)
            self.levels.append(level)
            inner = s[:-1] >= 0
            joined = inner & (s[1:] >= 0)  # neighbours in one document
            if not joined.any():
                break
            same = joined & (s[:-1] == s[1:])
            if same.any():
                starts = np.append(True, ~same)
                at = np.flatnonzero(starts)
                sizes = np.diff(np.append(at, len(s)))
                up, free = s[at].copy(), free
                free = self.rename(up, np.flatnonzero(sizes > 1), s[at], sizes, free)
                level.close(starts, True)
                s = up
                level = Level(s)
                self.levels.append(level)
                joined = (s[:-1] >= 0) & (s[1:] >= 0)
                if not joined.any():
                    break
            names, code = np.unique(s, return_inverse=True)
            left = (rng.random(len(names)) < 0.5)[code]
            pair = joined & left[:-1] & ~left[1:]
            starts = np.append(True, ~pair)
            at = np.flatnonzero(starts)
            up = s[at].copy()
            second = np.append(s, -1)[at + 1]
            free = self.rename(up, np.flatnonzero(np.append(pair, False)[at]), s[at], second, free)
            level.close(starts, False)
            s = up

    @staticmethod
    def rename(up: np.ndarray, places: np.ndarray, a: np.ndarray, b: np.ndarray, free: int) -> int:
        """New symbols for the different (a, b) at ``places``; returns the next free one."""
        if not len(places):
            return free
        _, code = np.unique((a[places].astype(np.int64) << 32) | b[places].astype(np.int64), return_inverse=True)
        up[places] = free + code
        return free + int(code.max()) + 1

    def agree(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal symbols of the text from places x and y on (``back``: before them); x < y, in one document."""
        begin = x
        x, y = x.astype(np.int64), y.astype(np.int64)
        top = np.zeros(len(x), np.int64)  # level on which a question stopped climbing
        climbing = np.arange(len(x))
        for k, level in enumerate(self.levels[:-1]):
            if not len(climbing):
                break
            a, b = x[climbing], y[climbing]
            free = level.first[a] & level.first[b]
            n, met = self.advance(level, a, b, back)
            n[free] = 0
            a, b = (a - n, b - n) if back else (a + n, b + n)
            x[climbing], y[climbing] = a, b
            on = free | (met & level.first[a] & level.first[b])
            top[climbing[~on]] = k
            climbing = climbing[on]
            x[climbing], y[climbing] = level.parent[x[climbing]], level.parent[y[climbing]]
            top[climbing] = k + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = np.flatnonzero(top >= k)
            if k + 1 < len(self.levels):
                down = np.flatnonzero(top > k)
                x[down], y[down] = level.child[x[down]], level.child[y[down]]
            while len(here):
                n, met = self.advance(level, x[here], y[here], back)
                x[here], y[here] = (x[here] - n, y[here] - n) if back else (x[here] + n, y[here] + n)
                here = here[met]
        return begin - x if back else x - begin

    @staticmethod
    def advance(level: Level, a: np.ndarray, b: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to go on by where the next ones are equal, and whether they are."""
        s = level.symbols
        i, j = (a - 1, b - 1) if back else (a, b)
        met = (s[np.maximum(i, 0)] == s[np.minimum(j, len(s) - 1)]) & (i >= 0) & (j < len(s))
        n = met.astype(np.int64)
        if getattr(level, "blocks", False) and met.any():
            p, q = level.parent[i[met]], level.parent[j[met]]
            if back:
                n[met] = np.minimum(a[met] - level.child[p], b[met] - level.child[q])
            else:
                n[met] = np.minimum(level.child[p + 1] - a[met], level.child[q + 1] - b[met])
        return n, met


def grid(longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, period) of all grid steps of a text of ``longest`` words, and the words each needs, ascending in these."""
    periods = np.arange(1, longest // PERIODS + 1)
    # the last word looked at is three steps on; it must exist
    n = np.maximum(0, (longest - 1) // periods - (PERIODS - 2))
    q = np.repeat(periods, n)
    k = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
    need = (k + PERIODS - 1) * q + 1
    order = np.argsort(need, kind="stable")
    return (k * q)[order], q[order], need[order]


def candidates(words: np.ndarray, steps: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) where the words on the grid agree over PERIODS - 1 steps."""
    n = len(words)
    if steps is not None:
        end = int(np.searchsorted(steps[2], n, "right"))
        at, q = steps[0][:end], steps[1][:end]
        for m in range(1, PERIODS):
            hit = words[at] == words[at + m * q]
            at, q = at[hit], q[hit]
        return at, q
    found, first = [], 1
    while first <= n // PERIODS:  # a long text: some periods at a time
        last = first
        size = 0
        while last <= n // PERIODS and size < STEP:
            size += n // last
            last += 1
        periods = np.arange(first, last)
        count = np.maximum(0, (n - 1) // periods - (PERIODS - 2))
        q = np.repeat(periods, count)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)) * q
        for m in range(1, PERIODS):
            hit = words[at] == words[at + m * q]
            at, q = at[hit], q[hit]
        found.append((at, q))
        first = last
    at, q = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return at, q


GRID = 4_096  # texts of up to so many words share one table of grid steps


def find_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of word numbers (0 and up), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    steps = grid(min(GRID, max([len(d) for d in docs] or [0])))
    parts, at = [], 0
    for i, d in enumerate(docs):
        if len(d) >= LEAST:
            place, q = candidates(d, steps if len(d) <= GRID else None)
            if len(place):
                parts.append((np.full(len(place), i), place, q, np.full(len(place), at), d))
                at += len(d) + 1
    if not parts:
        return out
    ends = -2 - np.arange(len(parts))
    text = np.concatenate([np.concatenate([p[4], [e]]) for p, e in zip(parts, ends)]).astype(np.int64)
    grammar = Grammar(text)
    doc, place, q, base = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((place, q, doc))
    doc, place, q, base = doc[order], place[order], q[order], base[order]
    starts, stops, periods, owners = [], [], [], []
    while len(doc):
        # the first of neighbouring grid places asks; those that its answer covers need not
        follows = (doc[1:] == doc[:-1]) & (q[1:] == q[:-1]) & (place[1:] == place[:-1] + q[1:])
        ask = np.flatnonzero(np.append(True, ~follows))
        x = base[ask] + place[ask]
        y = x + q[ask]
        back, on = grammar.agree(x, y, True), grammar.agree(x, y, False)
        lo, hi = place[ask] - back, place[ask] + q[ask] + on
        good = hi - lo >= np.maximum(LEAST, PERIODS * q[ask])
        owners.append(doc[ask][good])
        starts.append(lo[good])
        stops.append(hi[good])
        periods.append(q[ask][good])
        group = np.cumsum(np.append(True, ~follows)) - 1
        # words from the asking place on that lie in its stretch are settled
        left = place >= (place[ask] + on)[group]
        left[ask] = False
        doc, place, q, base = doc[left], place[left], q[left], base[left]
    owner, lo, hi, q = map(np.concatenate, (owners, starts, stops, periods))
    order = np.lexsort((q, hi, lo, owner))
    owner, lo, hi, q = owner[order], lo[order], hi[order], q[order]
    # a stretch also repeats with multiples of its smallest period: the smallest stays
    new = np.append(True, (owner[1:] != owner[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) if len(owner) else np.zeros(0, bool)
    found = sorted(zip(owner[new].tolist(), lo[new].tolist(), q[new].tolist(), hi[new].tolist()))
    for i, a, p, b in found:
        out[i].append((a, b - a, p))
    return out


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Greatest exact length/period; ties: smallest start, then period."""
    best = None
    for r in runs:  # by start, then period, so only a greater one replaces
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        gone[a + p] += 1
        gone[a + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def turn_of(doc_id: Column) -> Column:
    """The ``turn`` of op12's contract: a tenth of the crc32 of the id's text where that is divisible by ten, else null."""
    h = F.crc32(doc_id.cast("string"))
    return F.when(h % 10 == 0, F.floor(h / 10))


def repeat_words(words: list[str], turn: int | None) -> list[str]:
    """With a ``turn``, the words from ``turn % n`` on become repeats of the first of them; see the contract of op12."""
    n = len(words)
    if turn is None or not n:
        return words
    a = turn % n
    p = 1 + (n - a) // (3 + turn % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[:n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turn: Column | None = None,
                  with_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row.

    A run is a stretch of words with smallest period q of at least
    ``max(6, 4 q)`` words that cannot be extended. A null, empty or blank text
    has no words: no runs, null start, length, period and exponent, and the
    hashes of empty strings. Null and repeated ids are kept, one result row per
    input row. A text of any length is handled whole; texts over BLOCK_WORDS
    words are handled by themselves. Ties go to the smallest start, then the
    smallest period. Only the named columns are read, so others cannot clash.
    ``turn`` (a column) makes a text periodic first, see ``repeat_words``.
    ``with_runs`` adds all runs as an array of (start, length, period) and the kept text.
    """
    named = [docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (F.lit(None) if turn is None else turn).cast("long").alias("turn")]
    rows = docs.select(*named)
    word = re.compile(WORD)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    more = ["runs", "collapsed"] if with_runs else []
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def handle(texts: list[list[str]]) -> list[tuple]:
        numbers: dict[str, int] = {}
        coded = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in texts]
        out = []
        for t, runs in zip(texts, find_runs(coded)):
            best = best_run(runs)
            listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
            kept = " ".join(kept_words(t, runs))
            digests = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (listed, kept)]
            first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            extra = ([{"start": a, "length": n, "period": p} for a, n, p in runs], kept) if with_runs else ()
            out.append((len(runs), *first, *digests, *extra))
        return out

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [run_type, pa.string()]
        for b in batches:
            got, block, size = [], [], 0
            for t, turn in zip(b.column("text"), b.column("turn").to_pylist()):
                words = repeat_words(word.findall(t.as_py() or ""), turn)
                if block and size + len(words) > BLOCK_WORDS:
                    got += handle(block)
                    block, size = [], 0
                block.append(words)
                size += len(words)
            got += handle(block)
            columns = [pa.array(v, types[i]) for i, v in enumerate(zip(*got))] if got else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names, *more])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
              "collapsed_sha256 string")
    if with_runs:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(batch, schema)
