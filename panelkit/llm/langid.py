"""Language identification by words first, then shorter and shorter character n-grams.

A word known from training is scored by its log frequency in each language. A
word never seen is cut into n-grams of the longest length; if none of them is
known the next shorter length is tried, down to single letters.

The model is fitted on a bounded sample of labelled documents: about
``SAMPLE`` of each language, chosen by hash, so that a rare language is learnt
like a frequent one. All words and n-grams of the sample are kept. Every
document's whole text is scored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import held_out, pick
from panelkit.session import scratch_path

SAMPLE = 1_000
LONGEST = 4
CACHE_WORDS = 400_000
BLOCK_CHARS = 4_000_000


LETTERS = r"[^\W\d_]+"  # letters and, besides digits, the other numbers


def other_numbers() -> str:
    """The numbers that are no digits (fractions, Roman numerals, circled digits), which are no letters either."""
    return "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))


@dataclass
class Table:
    """Smoothed log frequencies: a row of ``values`` (one number a language) for each entry."""

    places: dict[str, int]
    values: np.ndarray

    def get(self, entry: str) -> np.ndarray | None:
        at = self.places.get(entry)
        return None if at is None else self.values[at]


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: list[Table]  # by length - 1
    numbers: str


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Word and n-gram frequencies per language of a sample of the rows that are not held out and have a language.

    A row is in the sample if its hash is below its language's share, which
    gives about ``sample`` rows of each language (all, where there are fewer);
    its whole text trains.
    """
    spark = docs.sparkSession
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    path = scratch_path(spark, "langid-sample")
    shares = [(r["lang"], min(1.0, sample / r["n"])) for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    share = F.broadcast(spark.createDataFrame(shares, "lang string, share double"))  # a row a language
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 11) / float(1 << 53)
    d.join(share, "lang").where(place < F.col("share")).select("lang", F.lower("text").alias("text")).write.parquet(path)
    s = spark.read.parquet(path).repartition(F.xxhash64("text"))
    w = s.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    words_path = scratch_path(spark, "langid-words")
    w.write.parquet(words_path)
    w = spark.read.parquet(words_path)
    langs = sorted(r["lang"] for r in w.select("lang").distinct().collect())
    grams = []
    for n in range(1, LONGEST + 1):
        padded = F.concat(F.lit(" "), "g", F.lit(" "))
        g = w.select("lang", "n", F.explode(F.transform(
            F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))).alias("g")) if n > 1 else w.select(
            "lang", "n", F.explode(F.split("g", "")).alias("g")).where("g <> ''")
        grams.append(_table(g.where(F.trim("g") != "").groupBy("lang", "g").agg(F.sum("n").alias("n")), langs))
    return Model(langs, _table(w, langs), grams, other_numbers())


def _table(counts: DataFrame, langs: list[str]) -> Table:
    """All entries of the sample as smoothed log frequencies per language."""
    code = {x: i for i, x in enumerate(langs)}
    rows = counts.toArrow()
    names = rows.column("g").combine_chunks().dictionary_encode()
    n = np.full((len(names.dictionary), len(langs)), 0.1)
    at = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
    np.add.at(n, (names.indices.to_numpy(), at), rows.column("n").to_numpy())
    totals = 1.0 + np.bincount(at, rows.column("n").to_numpy(), minlength=len(langs))
    return Table({g: i for i, g in enumerate(names.dictionary.to_pylist())}, np.log(n / totals).astype(np.float32))


class Scorer:
    """Scores words with a bounded cache; one per task."""

    def __init__(self, langs: list[str], words: Table, grams: list[Table], numbers: str):
        self.langs, self.words, self.grams = langs, words, grams
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, len(langs)), np.float32)
        self.numbers = frozenset(numbers)
        self.plain, self.exact = re.compile(LETTERS), re.compile(LETTERS.replace("_", "_" + numbers))

    def word(self, w: str) -> np.ndarray:
        known = self.words.get(w)
        if known is not None:
            return known
        p = f" {w} "
        for n in range(len(self.grams), 0, -1):
            places = self.grams[n - 1].places
            hits = [places[g] for g in ([p[i:i + n] for i in range(len(p) - n + 1)] if n > 1 else w) if g in places]
            if hits:
                return self.grams[n - 1].values[hits].sum(axis=0) / (len(hits) if n == 1 else max(1, len(hits) / 2))
        return np.zeros(len(self.langs), np.float32)

    def codes(self, words) -> list[int]:
        """A row of ``rows`` for each word."""
        out = []
        for w in words:
            c = self.cache.get(w)
            if c is None:
                c = self.cache[w] = len(self.cache)
                if c >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[c] = self.word(w)
            out.append(c)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        counts: Counter = Counter()
        text, at = text or "", 0
        letters = self.plain if text.isascii() or self.numbers.isdisjoint(text) else self.exact
        while at < len(text):
            end = at + BLOCK_CHARS
            if end < len(text) and (rest := letters.match(text, end)):
                end = rest.end()  # a word at the border stays whole
            counts.update(letters.findall(text[at:end].lower()))
            at = end
        if not counts or not self.langs:
            return "und", 0.0
        total, part = np.zeros(len(self.langs)), list(counts.items())
        for at in range(0, len(part), CACHE_WORDS):
            if at:
                self.cache.clear()
            words, n = zip(*part[at:at + CACHE_WORDS])
            codes = self.codes(words)
            total += np.array(n, np.float64) @ self.rows[codes]
        total -= total.max()
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total).sum())


def language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; score is the winner's posterior under equal priors.

    ``und`` with score 0 if the text is null, has no letter, or nothing was
    learnt; numbers of any kind are no letters. Of equal scores the first
    language by name wins. Null and repeated ids and repeated rows keep their
    rows; only the two named columns are read, so others cannot clash. A very
    long text is read in blocks of ``BLOCK_CHARS`` characters that end between
    words, so its result does not depend on them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            langs, scores = [], []
            for at in range(0, b.num_rows, 256):
                for t in b.column("text").slice(at, 256).to_pylist():
                    lang, score = scorer.predict(t)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
