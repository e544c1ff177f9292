"""Suffix-array and substring dedup against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from panelkit.llm import cover as C
from panelkit.llm.passages import substring_dedup
from panelkit.llm.suffixes import suffix_dedup, suffix_dedup_rows


def brute_bytes(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for x in raw:
        for k in range(len(x) - width + 1):
            count[x[k:k + width]] = count.get(x[k:k + width], 0) + 1
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - width + 1):
            if count[x[k:k + width]] > 1:
                gone[k:k + width] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < order(i):
                gone[k:k + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def corpus(prose):
    r = random.Random(3)
    shared = prose(90, seed=1)
    rows = [(i, " ".join(prose(r.randint(5, 160)))) for i in range(30)]
    rows += [(100 + i, " ".join(prose(20) + shared[i % 7:60 + i] + prose(15))) for i in range(12)]  # one passage, shifted
    near = prose(150, seed=2)
    for i in range(12):  # near copies
        x = list(near)
        x[r.randrange(150)] = f"edit{i}"
        rows.append((200 + i, " ".join(x)))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (302, "a" * 700), (303, "ab " * 300), (304, "short")]
    rows += [(305, ""), (306, None), (None, " ".join(near)), (None, None), (307, "x" * 199), (308, "x" * 199)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_equals_brute_force(make, prose, hot):
    rows = corpus(prose)
    got = suffix_dedup(make(rows), hot=hot).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 200))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_dedup_of_a_very_long_text(make, prose):
    w = prose(40_000)
    texts = [" ".join(w + w[100:160]), " ".join(prose(50) + w[39_900:39_970])]
    got = {r["doc_id"]: r for r in suffix_dedup(make(list(enumerate(texts)))).collect()}
    for i, want in enumerate(brute_bytes(texts, 200)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want and want[1] > 0


def test_suffix_dedup_rows_keeps_columns_and_cuts_texts(make, prose):
    long = " ".join(prose(80, seed=9))
    out = {r["doc_id"]: r for r in suffix_dedup_rows(make([(1, long), (2, "before " + long), (3, None), (4, "é")])).collect()}
    assert out[1]["text"] == "" and out[2]["text"] == "before " and out[3]["text"] is None and out[4]["text"] == "é"
    assert out[2]["n_chars"] == 7 and out[2]["k1"] == "x" and out[2]["row"] == "z"


def test_substring_dedup_equals_brute_force(make, prose):
    rows = corpus(prose)
    got = substring_dedup(make(rows)).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_words(rows, 50))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_tables(make):
    assert suffix_dedup(make([])).count() == 0
    assert substring_dedup(make([])).count() == 0


def test_cover_aligns_any_two_positions():
    for v in (31, 133):
        d = set(C.difference_cover(v))
        assert all(any((i + s) % v in d and (j + s) % v in d for s in range(v)) for i in (0, 7) for j in range(v))


def test_span_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 64)
    x = np.random.default_rng(1).integers(0, 256, 5_000, dtype=np.uint64)
    x[3_000:3_400] = x[100:500]
    h = C.windows(x, np.arange(4_000), 200)
    assert (h[100:300] == h[3_000:3_200]).all() and len(np.unique(h)) == 4_000 - 201
