"""Packing of token ids into windows by a non-negative least squares plan.

1. One pass makes each document's ids, cuts off its full windows and stores
   the pieces; what is left of a document (shorter than a window) falls into a
   length class of ``grain`` tokens. Each task numbers its pieces per class.
2. The histogram of the classes (at most window / grain rows, whatever the
   data) goes to the driver. All combinations of up to three classes that fill
   a window are enumerated; non-negative least squares finds how often each is
   repeated to use up the histogram; the counts are rounded, within what is there.
3. The residual is packed greedily: first whole rests, longest class first,
   where a filling leaves at most ``slack`` tokens; the others are laid end to
   end and cut at the windows. The last window is cut into powers of two.

Only counts pass through the driver. A rest meets its place in the plan by its
number within its class: the task's offset plus its number in the task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import pick
from panelkit.llm.token_counts import PieceCounter
from panelkit.operators.joins import join_small
from panelkit.session import cut_lineage

GRAIN = 4  # tokens in a length class
SLACK = 8  # tokens that a greedy filling may leave open
FULL = 0  # the class of full windows
SLICE_BYTES = 12_000_000
CACHE_WORDS = 1_000_000


# White space of Unicode beside the six ASCII characters: separators for the tokenizer too.
OTHER_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class ByteSigns(dict):
    """Character code -> the signs that a byte-level tokenizer writes for the character's UTF-8 bytes.

    Printable ASCII stands for itself; pre-tokens hold no white space and no control characters.
    """

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        (signs, _), = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))
        self[code] = signs
        return signs


class IdMaker(PieceCounter):
    """Token ids of texts; the ids of a blank-delimited word are made once and looked up afterwards.

    No pre-token reaches over white space and no step before it looks past it,
    so a text's ids are those of its words, one after the other. Texts of a
    tokenizer that is built in another way go to the library whole.
    """

    def __init__(self, spec: str):
        import regex

        super().__init__(spec)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # where lower case first could change the result: special strings and marks that compose with a letter
        self.keep_case = "\\p{M}|" + "|".join(regex.escape(x[:2]) for x in self.specials or ["\0\0"])
        self.marked = self.split and regex.compile("\n|" + self.split.pattern)
        self.merge, self.byte_signs = self.tokenizer.model.tokenize, ByteSigns()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # blank-delimited words
        self.flat, self.ends = array("I"), array("q", [0])
        self.piece: dict[str, int] = {"\n": 0}  # lower-case pre-tokens; the first is the mark between words
        self.piece_flat, self.piece_ends = array("I"), array("q", [0, 0])

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            joined = "\n".join(part)
            if self.plain.fullmatch(joined) and not any(s in joined for s in self.specials):
                counts, ids = self.by_pieces(joined)
            else:
                whole = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                begins = np.cumsum([0, *[len(w) + 1 for w in part[:-1]]])
                places = np.fromiter((a for a, _ in whole.offsets), np.int64, len(whole.ids))
                counts, ids = np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=len(part)), whole.ids
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            self.ends.frombytes((self.ends[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
            self.flat.frombytes(np.asarray(ids, np.uint32).tobytes())

    def by_pieces(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Id counts and ids of the words between line ends, from the ids of their pre-tokens."""
        cut = self.marked.findall(joined.lower())
        at = np.fromiter(map(self.piece.get, cut, repeat(-1)), np.int64, len(cut))
        late = np.flatnonzero(at < 0).tolist()
        if late:
            new = list(dict.fromkeys(map(cut.__getitem__, late)))
            each = [[t.id for t in self.merge(x if x.isascii() else x.translate(self.byte_signs))] for x in new]
            self.piece.update(zip(new, range(len(self.piece), len(self.piece) + len(new))))
            ends = self.piece_ends[-1] + np.cumsum(list(map(len, each)))
            self.piece_ends.frombytes(ends.astype(np.int64).tobytes())
            self.piece_flat.frombytes(np.fromiter(chain.from_iterable(each), np.uint32).tobytes())
            at[late] = np.fromiter(map(self.piece.__getitem__, map(cut.__getitem__, late)), np.int64, len(late))
        ends = np.frombuffer(self.piece_ends, np.int64)
        n = ends[at + 1] - ends[at]
        ids = np.frombuffer(self.piece_flat, np.uint32)[np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        word = np.cumsum(at == 0)
        return np.bincount(word, n, minlength=int(word[-1]) + 1).astype(np.int64), ids

    def ids(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, closed by ``end``; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.split is None:
            each = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array([*e.ids, end], self.dtype) for e in each]
        if pc.any(pc.match_substring_regex(texts, OTHER_SPACE)).as_py():
            texts = pc.replace_substring_regex(texts, OTHER_SPACE, " ")
        if not pc.any(pc.match_substring_regex(texts, self.keep_case)).as_py():
            texts = pc.ascii_lower(texts)  # as the tokenizer does; fewer different words
        words = pc.ascii_split_whitespace(texts)
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(distinct) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(self.place), len(self.place) + len(new))
        self.learn(list(map(distinct.__getitem__, new.tolist())))
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        ends = np.frombuffer(self.ends, np.int64)
        # 32-bit places: a slice and the ids kept are far below 2^31
        begin, count = ends[at].astype(np.int32), (ends[at + 1] - ends[at]).astype(np.int32)  # of the different words
        del ends
        at = coded.indices.to_numpy()
        n = count[at]
        total = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=total[1:])
        place = np.repeat(begin[at] - total[:-1], n)
        place += np.arange(total[-1], dtype=np.int32)
        got = flat.take(place).astype(self.dtype)
        del flat  # views lock the growing arrays
        bounds = total[np.append(0, np.cumsum(sizes))].tolist()
        last = np.array([end], self.dtype)
        return [np.concatenate((got[a:b], last)) for a, b in zip(bounds, bounds[1:])]


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Consecutive texts of about ``size`` bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= size:
            yield texts.slice(begin, i + 1 - begin)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield texts.slice(begin)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def shallow_combinations(units: int) -> np.ndarray:
    """All multisets of up to three classes whose sum is ``units``; 0 stands for no class."""
    rows = [(units, 0, 0)] + [(units - b, b, 0) for b in range(1, units // 2 + 1)]
    for c in range(1, units // 3 + 1):
        rows += [(units - b - c, b, c) for b in range(c, (units - c) // 2 + 1)]
    return np.array(rows)


def nnls(columns: np.ndarray, wanted: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """min |A x - wanted|, x >= 0, by an active set; column j of A counts the classes in ``columns[j]``.

    ``wanted[0]`` belongs to no class. At most one column a class is in use at
    a time, so the work depends on the window and the grain alone.
    """
    m = len(wanted)
    x, used = np.zeros(len(columns)), []
    rest = wanted.astype(float).copy()
    rest[0] = 0
    limit = tol * max(1.0, float(np.abs(wanted).max()))
    gram, right = np.zeros((0, 0)), np.zeros(0)  # normal equations of the columns in use
    for _ in range(6 * m):
        gain = rest[columns].sum(1)
        gain[used] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= limit:
            break
        same = (columns[used][:, :, None] == columns[j]) & (columns[j] > 0)
        own = ((columns[j][:, None] == columns[j]) & (columns[j] > 0)).sum()
        beside = same.sum((1, 2)).astype(float).reshape(-1, 1)
        gram = np.block([[gram, beside], [beside.T, np.array([[float(own)]])]])
        right = np.append(right, wanted[columns[j]][columns[j] > 0].sum())
        used.append(j)
        while used:
            try:
                z = np.linalg.solve(gram, right)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(gram, right, rcond=None)[0]
            if (z > 0).all():
                x[used] = z
                break
            at = x[used]
            low = z <= 0
            step = (at[low] / np.maximum(at[low] - z[low], 1e-300)).min()
            at = at + step * (z - at)
            keep = at > 1e-12 * (1 + np.abs(at).max())
            x[used] = np.where(keep, at, 0)
            used = [u for u, k in zip(used, keep) if k]
            gram, right = gram[np.ix_(keep, keep)], right[keep]
        filled = np.bincount(columns[used].ravel(), np.repeat(x[used], 3), minlength=m) if used else np.zeros(m)
        rest = wanted - filled
        rest[0] = 0
    return x


@dataclass
class Plan:
    """Where the k-th rest of each class goes; ``laid`` holds the classes whose later rests are laid end to end."""

    segments: list[tuple[int, int, int, int, int, int]]  # class, from, to, first sequence, rests a sequence, first slot
    planned: np.ndarray  # class -> rests with a whole place
    sequences: int


def plan_windows(counts: np.ndarray, grain: int, slack: int) -> Plan:
    """Repeats of window fillings for a histogram; ``counts[c]`` rests of class c (c * grain tokens at most)."""
    units = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    repeats: list[tuple[tuple[int, ...], int]] = []
    if left.any():
        columns = shallow_combinations(units)
        present = np.append(left, 0) > 0
        present[0] = True
        columns = columns[present[columns].all(1)]
        if len(columns):
            x = nnls(columns, left)
            for j in np.argsort(-x, kind="stable"):
                if (n := round(x[j])) == 0:
                    break
                use = Counter(int(c) for c in columns[j] if c)
                n = min([n, *(int(left[c]) // k for c, k in use.items())])
                if n > 0:
                    for c, k in use.items():
                        left[c] -= n * k
                    repeats.append((tuple(use.elements()), n))
    greedy = left.copy()
    while greedy.any():
        free, use = units, Counter()
        can = greedy.copy()
        while free:
            fit = np.flatnonzero(can[:free + 1])
            if not len(fit):
                break
            c = int(fit[-1])
            n = min(free // c, int(can[c]))
            use[c] += n
            can[c] -= n
            free -= n * c
        if free * grain > slack:  # the longest class here cannot be filled up: its rests are cut
            greedy[np.flatnonzero(greedy)[-1]] = 0
            continue
        n = min(int(greedy[c]) // k for c, k in use.items())
        for c, k in use.items():
            greedy[c] -= n * k
            left[c] -= n * k
        repeats.append((tuple(use.elements()), n))
    segments, at, first = [], np.zeros(units + 1, np.int64), 0
    for classes, n in repeats:
        slot = 0
        for c, k in Counter(classes).items():
            segments.append((c, int(at[c]), int(at[c]) + n * k, first, k, slot))
            at[c] += n * k
            slot += k
        first += n
    return Plan(segments, at, first)


def token_pieces(docs: DataFrame, tokenizer_path: str, end: int, window: int, grain: int,
                 id_col: str, text_col: str) -> DataFrame:
    """Stored pieces: every full window (class 0) and the rest of each document (class of its length), with ids.

    ``number`` and ``before`` count the pieces and their tokens in the class earlier in the same task.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        # the maker and what it has learnt stay in the worker process for its next tasks
        shared = docs.sparkSession.sparkContext.broadcast({"spec": f.read()})
    rows = pick(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", "part", "row", "class", "number", "before", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        maker = shared.value.get("maker") or shared.value.setdefault("maker", IdMaker(shared.value["spec"]))
        part = TaskContext.get().partitionId()
        numbers, tokens, row = Counter(), Counter(), 0
        for b in batches:
            doc_ids, at = b.column("doc_id"), 0
            for block in slices(b.column("text"), SLICE_BYTES):
                took, out = [], []
                for ids in maker.ids(block, end):
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window]
                        n = len(piece)
                        c = FULL if n == window else -(-n // grain)
                        out.append((part, row, c, numbers[c], tokens[c], start, n, crc(piece), len(ids), piece.tobytes()))
                        numbers[c] += 1
                        tokens[c] += n
                        took.append(at)
                    row, at = row + 1, at + 1
                columns = [pa.array(v, pa.binary() if i == 9 else pa.int64()) for i, v in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(took)), *columns], names)

    kinds = ", ".join(f"{c} long" for c in names[1:-1])
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(cut, f"doc_id {id_type}, {kinds}, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end: int = 1, grain: int = GRAIN, slack: int = SLACK,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (``with_ids``: and its ids, little-endian).

    A document's ids are followed by ``end``. A null or empty text has that id
    alone. Null and repeated ids are kept: each row is packed by itself. A very
    long text gives as many full windows as it holds. Equal texts are packed
    like any others. An empty table gives no pieces. Only the two named columns
    are read, so other columns cannot clash. ``window`` is a power of two and
    a multiple of ``grain``. Files in the same order give the same packing.
    """
    if window % grain or window & (window - 1):
        raise ValueError("the window must be a power of two and a multiple of the grain")
    spark = docs.sparkSession
    units = window // grain
    stored = token_pieces(docs, tokenizer_path, end, window, grain, id_col, text_col)
    tasks = stored.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cut_lineage(tasks.select("class", "part", "n", "tokens", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_earlier") for c in ("n", "tokens")]))
    counts, lengths = np.zeros(units + 1, np.int64), np.zeros(units + 1, np.int64)
    for r in tasks.groupBy("class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("t")).collect():  # at most units + 1 rows
        counts[r["class"]], lengths[r["class"]] = r["n"], r["t"]
    full = int(counts[FULL])
    counts[FULL] = lengths[FULL] = 0
    plan = plan_windows(counts, grain, slack)

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    rows = join_small(stored, tasks.drop("n", "tokens"), ["class", "part"])
    rows = rows.withColumns({"number": F.col("number") + F.col("n_earlier"), "before": F.col("before") + F.col("tokens_earlier")})
    windows = rows.where(F.col("class") == FULL).select(*kept, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Whole rests: the plan has at most three segments a filling, so its table is bounded by the window.
    segments = spark.createDataFrame(plan.segments or [(-1, 0, 0, 0, 1, 0)], "class long, from long, to long, first long, each long, slot long")
    placed = rows.join(F.broadcast(segments), "class").where("number >= from and number < to")
    turn = F.col("number") - F.col("from")
    placed = placed.select(*kept, (full + F.col("first") + F.floor(turn / F.col("each"))).alias("sequence_id"),
                           (F.col("slot") + turn % F.col("each")).alias("slot"))
    in_window = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*kept, "sequence_id", F.coalesce(F.sum("length").over(in_window), F.lit(0)).alias("offset"))

    # The others, end to end from the longest class on.
    planned = spark.createDataFrame([(c, int(n)) for c, n in enumerate(plan.planned) if c != FULL], "class long, planned long")
    others = rows.join(F.broadcast(planned), "class").where("number >= planned")
    begins = {r["class"]: r["b"] for r in others.groupBy("class").agg(F.min("before").alias("b")).collect()}
    base, total = {}, 0
    for c in sorted(begins, reverse=True):
        base[c] = total - begins[c]
        total += int(lengths[c]) - begins[c]
    bases = spark.createDataFrame(list(base.items()) or [(-1, 0)], "class long, base long")
    laid = others.join(F.broadcast(bases), "class").select(*[c for c in kept if c != "ids"], "ids", (F.col("base") + F.col("before")).alias("at"))
    laid = cut_pieces(laid, window, total, full + plan.sequences, with_ids)
    return windows.unionByName(placed).unionByName(laid)


def cut_pieces(laid: DataFrame, window: int, total: int, first: int, with_ids: bool) -> DataFrame:
    """Rests that lie at ``at`` in one row of ``total`` ids, cut at the windows; the last window ends in powers of two."""
    whole = total - total % window
    tail = [whole]
    for b in range(window.bit_length() - 1, -1, -1):
        if total % window >> b & 1:
            tail.append(tail[-1] + (1 << b))

    def places(at: int, to: int) -> list[tuple[int, int, int, int]]:
        """(sequence, offset, from, to) of each part of [at, to)."""
        out = []
        while at < to:
            if at < whole:
                i, begin, stop = at // window, at - at % window, at - at % window + window
            else:
                k = int(np.searchsorted(tail, at, "right")) - 1
                i, begin, stop = whole // window + k, tail[k], tail[k + 1]
            out.append((first + i, at - begin, at, min(to, stop)))
            at = min(to, stop)
        return out

    names = [c for c in laid.columns if c not in ("at", "ids")] + (["ids"] if with_ids else []) + ["sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took, out = [], []
            starts, lengths = b.column("start").to_pylist(), b.column("length").to_pylist()
            for i, (at, ids) in enumerate(zip(b.column("at").to_pylist(), b.column("ids"))):
                raw = ids.as_buffer()
                ids = np.frombuffer(raw, f"<u{len(raw) // lengths[i]}")
                for seq, offset, lo, hi in places(at, at + lengths[i]):
                    piece = ids[lo - at:hi - at]
                    took.append(i)
                    out.append((starts[i] + lo - at, hi - lo, crc(piece), seq, offset, piece.tobytes()))
            start, length, crcs, seq, offset, raw = zip(*out) if out else [()] * 6
            new = {"start": start, "length": length, "ids_crc32": crcs, "sequence_id": seq, "offset": offset}
            take = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()) if c == "ids" else pa.array(new[c], pa.int64()) if c in new else b.column(c).take(take)
                 for c in names], names)

    schema = ", ".join(f"`{c}` {dict(laid.dtypes).get(c, 'bigint')}" for c in names)
    return laid.mapInArrow(cut, schema)


def sequences(packed: DataFrame, dtype: str) -> DataFrame:
    """sequence_id, ids, offsets of the packed windows, from ``pack(..., with_ids=True)``; a group holds one window.

    ``dtype`` is the width of the stored ids: ``<u2`` for vocabularies of up to 65,536 ids, else ``<u4``.
    """
    def join(parts):
        ids = np.concatenate([np.frombuffer(p, dtype) for p in parts])
        return ids.astype("int64").tolist()

    glue = F.udf(join, "array<long>")
    one = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return one.select("sequence_id", glue(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("offsets"))


def vocabulary_width(tokenizer_path: str) -> str:
    """The ``dtype`` of stored ids for a tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return IdMaker(json.dumps(json.load(f))).dtype
