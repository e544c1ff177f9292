"""Token counts without token ids.

A pre-token (the tokenizer's unit before its merges) always yields the same
number of pieces, so pieces are counted once per distinct pre-token of a block
of documents and joined to the documents' pre-token frequencies. Texts of
plain characters are split by the tokenizer's pattern; texts with others (any
script) by the library's normalizer and pre-tokenizer. Only a text that holds
an added token's string is given to the library whole.

The join stays inside the task: there are almost as many (document, pre-token)
pairs as words, and shuffling them would move more bytes than the texts hold.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import pick

BLOCK_CHARS = 4_000_000
CACHE_WORDS = 1_000_000

# Characters for which lower-casing and white space mean the same in Python and
# in the tokenizer library, and which composition (NFC) leaves alone.
PLAIN = "[\\t-\\r -~¡-įı-ňŊ-ž‐-‧€]*"


class PieceCounter:
    """Counts pieces of texts with one tokenizer file (the JSON form of the tokenizers library)."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        cfg = json.loads(spec)
        self.specials = [a["content"] for a in cfg.get("added_tokens", [])]
        self.plain = regex.compile(PLAIN)
        self.split = None
        steps = (cfg.get("pre_tokenizer") or {}).get("pretokenizers") or []
        norms = [n["type"] for n in (cfg.get("normalizer") or {}).get("normalizers", [])]
        if (norms == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
                and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
                and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]):
            self.split = regex.compile(steps[0]["pattern"]["Regex"])
        # added tokens that are looked for in normalized text would have to be looked for there
        self.own_steps = (self.tokenizer.pre_tokenizer is not None
                          and not any(a.get("normalized") for a in cfg.get("added_tokens", [])))
        self.pieces: dict[str, int] = {}
        self.unit_pieces: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def frequencies(self, text: str) -> Counter | None:
        """Pre-token frequencies, or None where only the library itself is sure of the split."""
        if self.split is None or not self.plain.fullmatch(text) or any(s in text for s in self.specials):
            return None
        return Counter(self.split.findall(text.lower()))

    def units(self, text: str) -> Counter | None:
        """Frequencies of the units that the library's own normalizer and pre-tokenizer give, in any script.

        None for a text that holds an added token, which is cut out before
        these steps, and for tokenizers without a pre-tokenizer.
        """
        if not self.own_steps or any(s in text for s in self.specials):
            return None
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return Counter([unit for unit, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def learn_units(self, units: set[str]) -> None:
        """Count the pieces of units not seen before by the model alone."""
        new = units - self.unit_pieces.keys()
        if len(self.unit_pieces) + len(new) > CACHE_WORDS:
            self.unit_pieces.clear()
            new = units
        pieces = self.tokenizer.model.tokenize
        self.unit_pieces.update((u, len(pieces(u))) for u in new)

    def learn(self, words: set[str]) -> None:
        """Count the pieces of pre-tokens not seen before; the memory kept for them is bounded."""
        new = list(words - self.pieces.keys())
        if len(self.pieces) + len(new) > CACHE_WORDS:
            self.pieces.clear()
            new = list(words)
        for at in range(0, len(new), 5_000):
            part = new[at:at + 5_000]
            codes = self.tokenizer.encode_batch(part, add_special_tokens=False)
            self.pieces.update(zip(part, [len(c.ids) for c in codes]))

    def count(self, texts: list[str]) -> list[int]:
        tables = [self.frequencies(t) for t in texts]
        units = [self.units(t) if f is None else None for t, f in zip(texts, tables)]
        self.learn(set().union(*[t for t in tables if t]))
        self.learn_units(set().union(*[u for u in units if u]))
        get, get_unit = self.pieces.__getitem__, self.unit_pieces.__getitem__
        return [sum(map(mul, f.values(), map(get, f))) if f is not None else
                sum(map(mul, u.values(), map(get_unit, u))) if u is not None else self.whole(t)
                for t, f, u in zip(texts, tables, units)]


def blocks(texts: list[str | None], chars: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters; a longer text is a block of its own."""
    block, n = [], 0
    for t in texts:
        block.append(t or "")
        n += len(block[-1])
        if n >= chars:
            yield block
            block, n = [], 0
    if block:
        yield block


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids are
    kept, one result row per input row. Special strings inside a text count as
    the library's default does; nothing is truncated, and a very long text is
    counted whole, as a block of its own. The tokenizer file is
    read on the driver (a vocabulary, bounded) and sent to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(spec.value)
        for b in batches:
            n: list[int] = []
            for block in blocks(b.column("text").to_pylist(), BLOCK_CHARS):
                n += counter.count(block)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
