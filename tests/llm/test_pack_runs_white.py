"""Packing, periodic runs and whitening against the tokenizer library, brute force and numpy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelkit.llm import packing, periodic, whitening

ODD = [None, "", " \n\t ", "<|endoftext|> and <|startoftext|>x", "İstanbul ΣΑΣ ½ ² naïve é", "it's we'LL don't 'S", "日本語 テスト 123", "a\x1cb\x85c d"]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def check_packing(rows, docs, tokenizer, window):
    """Every id in one piece, checksums, gapless windows; returns the share of padding."""
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in docs]
    wanted = defaultdict(list)
    for (d, _), x in zip(docs, ids):
        wanted[d].append(x)
    seen = defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for d, texts in wanted.items():
        pieces = sorted(seen.pop(d))
        if len(texts) == 1:
            at = 0
            for start, n, crc, total in pieces:
                part = np.array(texts[0][start:start + n], "<u4").tobytes()
                assert (start, crc, total) == (at, zlib.crc32(part), len(texts[0])) and n > 0
                at += n
            assert at == len(texts[0])
        else:
            assert sum(p[1] for p in pieces) == sum(map(len, texts))
    assert not seen
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, sum(map(len, ids)))


def test_packing_holds_every_id_once(make, prose, tokenizer):
    path, lib = tokenizer
    r = random.Random(2)
    docs = [(i, " ".join(prose(r.choice([3, 40, 200, 700, 1_500])))) for i in range(300)]
    docs += [(1_000 + i, t) for i, t in enumerate(ODD)]
    docs += [(2_000 + i, " ".join(prose(90, seed=1))) for i in range(150)]  # one length holds a third of the rows
    docs += [(3_000, " ".join(prose(30_000))), (None, "no id"), (None, "no id"), (7, docs[7][1])]
    table = make(docs).repartition(5).cache()
    found = packing.pack(table, path, window=2048)
    rows = found.collect()
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_packing(rows, docs, lib, 2048) < 0.01
    again = sorted(map(str, packing.pack(table, path, window=2048).collect()))
    assert again == sorted(map(str, rows))
    assert packing.pack(make([]), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table, path, window=1000)


def test_packed_ids_join_to_windows(make, prose, tokenizer):
    path, lib = tokenizer
    docs = [(i, " ".join(prose(5 + 13 * i % 170))) for i in range(60)]
    found = packing.pack(make(docs), path, window=256, with_ids=True).cache()
    joined = {r["sequence_id"]: r for r in packing.sequences(found, packing.vocabulary_width(path)).collect()}
    for r in found.collect():
        ids = [*lib.encode(docs[r["doc_id"]][1], add_special_tokens=False).ids, 1]
        s = joined[r["sequence_id"]]
        assert s["ids"][r["offset"]:r["offset"] + r["length"]] == ids[r["start"]:r["start"] + r["length"]]
        assert r["offset"] in s["offsets"]
    assert sum(len(s["ids"]) for s in joined.values()) == sum(r["length"] for r in found.collect())


def test_least_squares_is_optimal_and_plan_counts_fit():
    rng = np.random.default_rng(4)
    for units in (8, 24, 64):
        columns = packing.shallow_combinations(units)
        assert (columns.sum(1) == units).all() and len({tuple(sorted(c)) for c in columns.tolist()}) == len(columns)
        counts = rng.integers(0, 900, units + 1)
        counts[0] = 0
        counts[units // 3] = 40_000
        x = packing.nnls(columns, counts)
        a = np.zeros((units + 1, len(columns)))
        np.add.at(a, (columns, np.arange(len(columns))[:, None]), 1)
        a[0] = 0
        slope = a.T @ (a @ x - counts)  # conditions of the optimum
        assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope[x > 0]).max() < 1e-3
        plan = packing.plan_windows(counts, 4, 8)
        assert (plan.planned <= counts).all()
        filled = defaultdict(int)
        for c, lo, hi, first, each, _ in plan.segments:
            for k in range((hi - lo) // each):
                filled[first + k] += c * each
        assert sorted(filled) == list(range(plan.sequences)) and all(units - 2 <= v <= units for v in filled.values())


def slow_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic_words(r, n):
    k = r.choice([1, 2, 3, 5, 40])
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        p, a, m = r.randint(1, 11), r.randint(0, max(0, n - 1)), r.randint(0, 90)
        cycle = [r.randrange(k) for _ in range(p)]
        w[a:a + m] = [cycle[i % p] for i in range(len(w[a:a + m]))]
    return w


def test_runs_equal_brute_force():
    r = random.Random(8)
    for _ in range(400):
        texts = [np.array(periodic_words(r, r.randint(0, 150)), np.int64) for _ in range(r.randint(1, 5))]
        assert periodic.find_runs(texts) == [slow_runs(t.tolist()) for t in texts]
    old, periodic.GRID = periodic.GRID, 50  # long texts go another way to the same candidates
    try:
        texts = [np.array(periodic_words(r, r.randint(40, 400)), np.int64) for _ in range(60)]
        assert periodic.find_runs(texts) == [slow_runs(t.tolist()) for t in texts]
    finally:
        periodic.GRID = old


def test_grammar_answers_equal_direct_comparison():
    r = random.Random(9)
    for _ in range(60):
        text = []
        for i in range(r.randint(1, 4)):
            text += periodic_words(r, r.randint(1, 80)) + [-2 - i]
        text = np.array(text)
        g = periodic.Grammar(text)
        pairs = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text)) if (text[i:j + 1] >= 0).all()]
        if not pairs:
            continue
        x, y = map(np.array, zip(*pairs))
        on, back = g.agree(x, y, False), g.agree(x, y, True)
        for i, j, n, m in zip(x, y, on, back):
            k = 0
            while text[j + k] >= 0 and text[i + k] == text[j + k]:
                k += 1
            b = 0
            while i - b > 0 and text[i - b - 1] >= 0 and text[i - b - 1] == text[j - b - 1]:
                b += 1
            assert (n, m) == (k, b)


def test_periodic_runs_of_documents(make, prose):
    r = random.Random(6)
    docs = [(i, " ".join(prose(r.choice([0, 3, 30, 200])))) for i in range(60)]
    docs += [(100 + i, " ".join(f"w{x}" for x in periodic_words(r, 150))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (None, "a b " * 9), (203, "x " * 70_000), (204, "é\x1cé é\x1cé " * 4), (5, docs[5][1])]
    table = make(docs)
    got = defaultdict(list)
    for x in periodic.periodic_runs(table, turn=periodic.turn_of(table["doc_id"]), with_runs=True).collect():
        got[x["doc_id"]].append(x)
    assert sum(map(len, got.values())) == len(docs)
    turned = 0
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            turned += 1
        runs = slow_runs(w) if len(w) < 5_000 else [(0, len(w), 1)]
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        x = got[d][0]
        assert [tuple(v) for v in x["runs"]] == runs and x["n_runs"] == len(runs)
        assert (x["start"], x["length"], x["period"]) == (best or (None,) * 3)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert x["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % v for v in runs).encode()).hexdigest()
        assert x["collapsed"] == kept and x["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert turned > 3
    assert periodic.periodic_runs(make([])).count() == 0


VECTORS = "vec_id long, embedding array<float>, n string, component string"


def vector_table(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v], "n", "c") for i, v in enumerate(x)] + list(more), VECTORS)


def check_whitening(rows, x, components):
    """Against numpy; rows keyed by position."""
    x = np.floor(64 * np.asarray(x, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    w = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(w) == len(rows) == n * k
    got = np.array([[w[i, j + 1]["whitened"] for j in range(k)] for i in range(n)])
    true = c @ q[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * true).sum(0))
    assert np.abs(got * sign - true).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    for r in rows[:: max(1, len(rows) // 200)]:
        assert r["n"] == n and r["deviation"] == sum(int(d) ** 2 for d in (n * x[r["vec_id"]] - s))
        assert abs(r["explained"] / (e[r["component"] - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 64)) * np.linspace(1, 2, 64)
    bad = [(9_000, None, "", ""), (9_001, [1.0, None] * 32, "", ""), (9_002, [float("nan")] * 64, "", ""),
           (9_003, [float("inf")] + [0.0] * 63, "", ""), (9_004, [], "", ""), (9_005, [1.0] * 3, "", "")]
    found = whitening.whiten(vector_table(spark, x, bad).repartition(4))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(found.collect(), x, 32)


def test_whitening_narrow_repeated_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    few = rng.normal(size=(200, 6))
    check_whitening(whitening.whiten(vector_table(spark, few)).collect(), few, 32)
    flat = rng.normal(size=(150, 3)) @ rng.normal(size=(3, 80)) * 50  # three directions and rounding
    check_whitening(whitening.whiten(vector_table(spark, flat), components=3).collect(), flat, 3)
    twice = [(None, [1.0, 2.0], "", ""), (1, [2.0, 1.0], "", ""), (1, [2.0, 1.0], "", "")]
    rows = whitening.whiten(spark.createDataFrame(twice, VECTORS)).collect()
    assert [r["vec_id"] for r in rows if r["vec_id"] is None] == [None] and len(rows) == 3  # one direction varies
    for rows in ([], [(1, [1.0, 2.0], "", "")], [(1, None, "", "")], [(i, [3.0, 3.0], "", "") for i in range(4)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], "", ""), (2, [-1e30, 0.0], "", "")], VECTORS)).collect()
    assert [r["deviation"] for r in huge] == [None, None]


def test_filter_separates_close_values():
    """A spectrum whose wanted end is 0.2 % above the rest, against numpy, with the passes counted."""
    rng = np.random.default_rng(7)
    d = 300
    e = np.sort(np.concatenate([np.linspace(60, 63, d - 40), np.linspace(63.2, 68, 38), [100, 110]]))[::-1]
    u = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (u * e) @ u.T

    class Local:
        dims, passes = d, 0

        def times(self, q):
            self.passes += 1
            return v @ q

    local = Local()
    got, q = whitening.leading(local, 32)
    assert np.abs(got - e[:32]).max() < 1e-10 * e[0] and local.passes < 150
    assert np.abs(v @ q - q * got).max() < 1e-9
