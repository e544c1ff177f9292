"""Token counts, quality rules, mixing, language, classifier and decontamination on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import crf, decontaminate, langid, mixing
from panelkit.llm.quality_rules import quality_rules
from panelkit.llm.token_counts import BLOCK_CHARS, PieceCounter, token_counts

tokenizers = pytest.importorskip("tokenizers")
ODD = [None, "", " \n\t ", "<|endoftext|> and <|startoftext|>x", "İstanbul ΣΑΣ ½ ² naïve é", "it's we'LL don't 'S",
       "a\x1cb\x85c d", "日本語 テスト 123", "!!'s ''ve 12a3 __x__", "ÀÉÎ ß Œ œ ñ"]


def test_token_counts_equal_the_library(make, prose):
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = ODD + [" ".join(prose(n)) for n in (1, 50, 3_000)]
    got = {r["doc_id"]: r for r in token_counts(make(list(enumerate(texts)) + [(None, "x y")]), public.path("word_bpe_49k.json")).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 2048), x
    assert got[None]["n_tokens"] == 2


def test_very_long_text_is_counted_whole(make, prose):
    public = pytest.importorskip("public_tokenizers")
    text = "\n".join(" ".join(prose(100)) for _ in range(6_000))
    assert len(text) > BLOCK_CHARS
    got = token_counts(make([(1, "a b"), (2, text), (3, "c")]), public.path("word_bpe_49k.json")).collect()
    n = len(tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: 2, 2: n, 3: 1}


def test_all_scripts_are_split_without_whole_encoding(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = tokenizers.Tokenizer.from_file(public.path(name))
        counter = PieceCounter(open(public.path(name), encoding="utf-8").read())
        r = random.Random(11)
        ranges = [(0x20, 0x250), (0x300, 0x600), (0x590, 0x780), (0x900, 0xD80), (0x1100, 0x1200), (0x2000, 0x2600),
                  (0x3040, 0x3100), (0x4E00, 0x5000), (0xAC00, 0xAD00), (0x1F300, 0x1F650)]
        texts = ["".join(chr(r.randrange(*r.choice(ranges))) if r.random() > 0.2 else r.choice(" \n\t\u00a0\u3000'") for _ in range(n))
                 for n in [1, 2, 3] * 60 + [200] * 60 + [20_000]]
        texts += [x for x in ODD if x] + ["Привет, мир! Это <|endoftext|> тест", "e\u0301 \u212b \u1e9b\u0323", "Ελληνικά ΣΊΣΥΦΟΣ"]
        assert counter.own_steps
        whole = PieceCounter.whole

        def only_special(self, text):
            assert any(s in text for s in self.specials), text
            return whole(self, text)

        monkeypatch.setattr(PieceCounter, "whole", only_special)
        assert counter.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
        monkeypatch.undo()


def test_quality_rules_counts_and_verdicts(make, prose):
    good = [(i, "\n".join(" ".join(prose(12)) + "." for _ in range(6))) for i in range(40)]
    junk = [(100 + i, "\n".join(" ".join(w + "###" for w in prose(12)) for _ in range(6))) for i in range(5)]
    junk += [(200 + i, " ".join(w.upper() + "!!" for w in prose(60))) for i in range(5)]
    rep = [(300, "der " * 100), (301, "\n".join(["one two three four five six"] * 20))]
    odd = [(400, None), (401, ""), (402, "few words"), (None, " ".join(prose(30)))]
    rows = good + junk + rep + odd
    got = {r["doc_id"]: r for r in quality_rules(make(rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if n[tuple(w[k:k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)), i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in junk + rep + odd[:3])
    assert quality_rules(make([])).count() == 0


def test_quality_rules_count_very_long_texts_whole(make, prose):
    w = prose(30_000)
    w += w[:9]  # two windows at the very end that also start the text
    r = quality_rules(make([(1, "\n".join(" ".join(w[k:k + 11]) for k in range(0, len(w), 11)))])).collect()[0]
    n = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if n[tuple(w[k:k + 8])] > 1 for j in range(8)}
    assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover)) and len(cover) >= 18


def test_quality_rules_run_without_python(make, prose):
    plan = quality_rules(make([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def targets(sizes, weights, cap):
    """Shares by weight, capped, the excess dealt again."""
    t = dict.fromkeys(sizes, 0.0)
    left, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > cap * sizes[s]]
        if not over:
            return t | {s: left * weights[s] / w for s in open_}
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
            open_.discard(s)
    return t


def test_mix_meets_targets(make, prose):
    r = random.Random(1)
    names = ["b", "a", "é", None, "small"]
    rows = [(i, " ".join(prose(r.randint(0, 60))), None, names[min(3, i % 6)] if i % 50 else "small") for i in range(1_500)]
    rows += [(7, "w " * 500, None, "a"), (7, "w " * 500, None, "a"), (None, None, None, "a"), (9_999, "", None, "z")]
    docs = make(rows)
    got = mixing.mix(docs, [5, 2, 1]).collect()
    again = mixing.mix(docs.repartition(3), [5, 2, 1]).collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["size"], x["taken"])
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    sizes, source = defaultdict(int), defaultdict(set)
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}, 3)
    by_id = {(i, len((t or "").split())): s for i, t, _, s in rows}
    taken = defaultdict(int)
    for x in got:
        s = by_id[(x["doc_id"], x["size"])]
        taken[s] += x["taken"]
        source[s].add((x["source_size"], round(x["target"], 6)))
        assert x["taken"] <= 3 * x["size"] and x["taken"] == sum(d["words"] for d in x["draws"])
    for s in sizes:
        assert source[s] == {(sizes[s], round(want[s], 6))}
        assert abs(taken[s] - want[s]) <= 4, s
    assert mixing.mix(make([]), [5, 2, 1]).count() == 0


def test_split_tree_keeps_quotas_and_shard_sizes():
    quota = np.array([1_000, 0, 37, 512])
    t = mixing.split_tree(quota, 7, np.random.default_rng(1))
    assert (t.sum(axis=0) == quota).all() and t.sum(axis=1).max() - t.sum(axis=1).min() <= 3 and (t >= 0).all()


def test_laid_out_shards_hold_the_mix(spark, make, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 6_000)
    monkeypatch.setattr(mixing, "FINE", 8)
    r = random.Random(2)
    rows = [(i, " ".join(prose(r.randint(0, 60))), None, "abc"[min(2, i % 7 // 2)] if i % 40 else None) for i in range(1_500)]
    rows += [(7, "w " * 900, None, "a")] * 3 + [(None, "x y\n z", None, "a")] * 2 + [(None, None, None, "a"), (5_000, " ".join(prose(30_000)), None, "b")]
    docs = make(rows).withColumns({"shard": F.lit("theirs"), "words": F.lit(1)})
    got = mixing.write_mix(docs, str(tmp_path / "m"), [5, 2, 1]).collect()
    plain = mixing.mix(docs, [5, 2, 1]).drop("draws").collect()
    key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["size"], x["taken"])
    assert sorted(got, key=key) == sorted(plain, key=key) and len(got) == len(rows)
    laid = spark.read.parquet(str(tmp_path / "m"))
    assert laid.columns == [*docs.columns, "mix_shard", "place", "pass", "mix_words", "row_key"]
    laid = laid.collect()
    assert sum(x["mix_words"] for x in laid) == sum(x["taken"] for x in got) and {x["shard"] for x in laid} == {"theirs"}
    shards, texts = defaultdict(list), defaultdict(set)
    for i, t, _, s in rows:
        texts[i].add(t)
    for x in laid:
        shards[x["mix_shard"]].append(x)
        assert x["mix_words"] == len(x["text"].split())
        assert x["text"] in texts[x["doc_id"]] or any((t or "").split()[:x["mix_words"]] == x["text"].split() for t in texts[x["doc_id"]])
    assert len(shards) > 5
    for rows_of in shards.values():  # gapless places, in an order that follows neither ids nor blocks
        rows_of.sort(key=lambda x: x["place"])
        assert [x["place"] for x in rows_of] == list(range(len(rows_of)))
        ids = [x["doc_id"] or 0 for x in rows_of]
        assert len(ids) < 10 or ids != sorted(ids)
    # a draw is in one shard: a row's passes never repeat
    seen = Counter((x["row_key"], x["pass"], x["doc_id"]) for x in laid)
    equal = Counter((i, t) for i, t, _, _ in rows)
    assert all(n <= max(v for (i, _), v in equal.items() if i == k[2]) for k, n in seen.items())
    assert mixing.write_mix(make([]), str(tmp_path / "e"), [5, 2, 1]).count() == 0


def test_more_sources_than_a_thousand(make):
    rows = [(i, "a b c d e", None, f"s{i % 1_500}") for i in range(4_500)] + [(10_000 + i, "long text " * 20, None, "zz") for i in range(500)]
    got = mixing.mix(make(rows), [5, 2, 1]).collect()
    per = defaultdict(lambda: [0, 0.0, 0])
    for x, n in ((x, x["taken"]) for x in got):
        k = f"s{x['doc_id'] % 1_500}" if x["doc_id"] < 10_000 else "zz"
        per[k][0] += n
        per[k][1] = x["target"]
        assert n <= 3 * x["size"]
    assert len(per) == 1_501 and all(abs(n - t) <= 4 for n, t, _ in per.values())


def test_targets_equal_repeated_resharing():
    r = random.Random(9)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 40, 1_000]) for _ in range(r.randint(1, 12))]
        weights = [r.choice([0, 1, 2, 5]) for _ in sizes]
        if sum(weights):
            got = mixing.water_fill(sizes, weights, 3)
            open_, left, want = {i for i, w in enumerate(weights) if w}, Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
            while open_:
                w = sum(weights[i] for i in open_)
                full = {i for i in open_ if left * weights[i] > 3 * sizes[i] * w}
                for i in full or open_:
                    want[i] = Fraction(3 * sizes[i]) if full else left * weights[i] / w
                if not full:
                    break
                left -= sum(want[i] for i in full)
                open_ -= full
            assert got == want


def test_language_on_held_out_rows(make, prose):
    def text(alphabet, seed):
        q = random.Random(seed)
        return " ".join("".join(q.choice(alphabet) for _ in range(q.randint(2, 7))) for _ in range(30))

    rows = [(i, text("abcdefg" if i % 2 else "ñópqrst", i), "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(900, None, "aa"), (901, "123 !!", None), (902, "", "bb"), (None, text("abcdefg", 5), None)]
    docs = make(rows)
    got = {r["doc_id"]: r for r in langid.language(docs, langid.fit(docs)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, None)] == ["und", "und", "und", "aa"]
    empty = make([])
    assert langid.language(empty, langid.fit(empty)).count() == 0


def slow_language(train, longest=4):
    """Word-first backoff from the training texts, one word at a time; returns text -> (language, score)."""
    import unicodedata

    def words(t):
        out = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower())
        return [w for w in out.split(" ") if w]

    langs = sorted({lang for t, lang in train if words(t)})
    seen = {lang: Counter(w for t, x in train if x == lang for w in words(t)) for lang in langs}

    def pieces(w, n):
        p = f" {w} "
        return list(w) if n == 1 else [p[i:i + n] for i in range(len(p) - n + 1)]

    grams = [{lang: Counter() for lang in langs} for _ in range(longest)]
    for lang in langs:
        for w, k in seen[lang].items():
            for n in range(1, longest + 1):
                for g in pieces(w, n):
                    if g.strip():
                        grams[n - 1][lang][g] += k

    def logs(table, g):
        return np.array([math.log((table[x][g] + 0.1) / (1 + sum(table[x].values()))) for x in langs])

    def score(w):
        if any(seen[x][w] for x in langs):
            return logs(seen, w)
        for n in range(longest, 0, -1):
            known = [g for g in pieces(w, n) if any(grams[n - 1][x][g] for x in langs)]
            if known:
                return sum(logs(grams[n - 1], g) for g in known) / (len(known) if n == 1 else max(1, len(known) / 2))
        return np.zeros(len(langs))

    def predict(t):
        found = Counter(words(t))
        if not found:
            return "und", 0.0
        total = sum(k * score(w) for w, k in found.items())
        e = np.exp(total - total.max())
        return langs[int(np.argmax(total))], float(e.max() / e.sum())

    return predict


def test_language_equals_slow_backoff(make, prose, monkeypatch):
    r = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["ru", "ka", "zen"], "cc": ["été", "ça", "lo"]}
    text = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, r.randint(1, 12)), lang) for i, lang in enumerate(r.choice(list(parts)) for _ in range(120))]
    odd = [(900, "½ ²"), (901, "①"), (902, "Ⅷ"), (903, None), (904, ""), (905, "12 3_4 !"), (906, "kalozen unseenword"), (907, "xq ½xq"),
           (908, "q"), (909, "mi" * 40), (910, "日本"), (911, text("bb", 300)), (None, "ka lo"), (905, "lo")]
    docs = make(rows + odd)
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    slow = slow_language(train)
    for block in (4_000_000, 7):  # the blocks of a long text do not change its words
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        scorer = langid.Scorer(*vars(langid.fit(docs)).values())
        for _, t, *_ in rows + odd:
            lang, score = scorer.predict(t)
            want = slow(t)
            assert score == pytest.approx(want[1], abs=2e-4) and (lang == want[0] or want[1] < 0.51), t
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language(docs, langid.fit(docs)).collect()}
    assert [got[i] for i in (900, 901, 902, 903, 904)] == ["und"] * 5


def test_rare_language_is_learnt(make):
    ids = [i for i in range(8_000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "common words of one language", "big") for i in ids[1:5_000]] + [(ids[0], "zyx wvu", "tiny")]
    model = langid.fit(make(rows), sample=20)
    assert model.langs == ["big", "tiny"]
    assert langid.Scorer(*vars(model).values()).predict("wvu zyx")[0] == "tiny"


def test_a_seed_of_very_many_items_is_cheap(make, spark):
    import time

    items = [(i, "which of the " + " ".join(f"q{i}x{j}" for j in range(17))) for i in range(20_000)]
    block = decontaminate.Items([t for _, t in items], 0.5, 3)
    block.set_seeds(1_000 * np.isin(block.vocabulary, decontaminate.fold("which of the")))
    x = decontaminate.fold(" ".join(["which of the and so on"] * 20 + [f"z{j}" for j in range(1_800)]) + " " + items[77][1])
    start = time.time()
    assert [k for k, *_ in block.scored(x)] == [77] and time.time() - start < 1
    bench = spark.createDataFrame(items[:3_000], "item_id long, text string")
    docs = make([(1, "which of the and so on " * 20), (2, "which of the " * 20 + items[5][1])])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()] == [(2, 5)]


def test_classifier_on_held_out_rows(spark, make, prose):
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        lines = [" ".join(prose(10)) + "." for _ in range(4)]
        if bad:
            lines[1:] = [" ".join(w + "***" for w in x.split()) for x in lines[1:]]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 0 if bad else 1))
    docs = make(rows + [(1_000, None), (1_001, ""), (None, "x"), (5, rows[5][1])])
    lab = spark.createDataFrame(labels + [(None, 1), (1_000, None)], "doc_id long, quality int")
    got = [r for r in crf.quality(docs, crf.train(docs, lab)).collect()]
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert crf.quality(make([]), crf.train(make([]), lab)).count() == 0


def test_forward_backward_equals_enumeration():
    q = np.random.default_rng(2)
    u, pairs = q.normal(size=(5, 1)), q.normal(size=(2, 2))
    p, counts = crf.forward_backward(u, np.array([5]), pairs, expect=True)
    total, good, moves = 0.0, np.zeros(5), np.zeros((2, 2))
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        w = np.exp(sum(u[i, 0] * y[i] for i in range(5)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
        for a, b in zip(y, y[1:]):
            moves[a, b] += w
    assert np.allclose(p[:, 0], good / total) and np.allclose(counts, moves / total)


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_scores_of_very_many_lines_do_not_depend_on_the_step(prose):
    lines = [" ".join(prose(k % 7)).encode() for k in range(66_000)]  # more than are featured at once
    weights = np.random.default_rng(1).normal(size=crf.line_features(lines[:3], 0, 3).shape[1])
    whole = crf.line_scores(lines, weights)
    assert len(whole) == len(lines) and np.allclose(whole, crf.line_scores(lines, weights, step=10_007), rtol=0, atol=1e-12)


def test_alignment_equals_full_table():
    q = random.Random(4)
    for _ in range(50):
        a = np.array([q.randrange(6) for _ in range(q.randint(3, 12))], np.uint64)
        b = np.array([q.randrange(6) for _ in range(q.randint(3, 25))], np.uint64)
        score, lo, hi = decontaminate.align(a, b)
        assert score == brute_align(a, b) and (not score or brute_align(a, b[lo:hi]) == score)


def test_decontamination_finds_edited_items(spark, make, prose):
    items = [(k, " ".join(prose(20 + k))) for k in range(10)]
    rows = [(i, " ".join(prose(120))) for i in range(40)]
    planted = {}
    for k, t in items:
        w = t.split()
        w[5] = "changed"
        del w[9]
        w.insert(12, "added")
        planted[100 + k] = k
        rows.append((100 + k, " ".join(prose(30) + w + prose(30))))
    rows += [(200 + i, " ".join(prose(10)) + " " + items[3][1].upper()) for i in range(30)]  # a very common item
    rows += [(300, None), (301, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    docs = make(rows)
    found = decontaminate.matches(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == set(planted.items()) | {(200 + i, 3) for i in range(30)} | {(None, 0)}
    clean = decontaminate.without_matches(docs, found)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(40)) | {300, 301}
    assert decontaminate.matches(make([]), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def all_pairs(rows, items):
    """Score of every text and item, by alignment of the whole text."""
    out = {}
    for i, t in rows:
        b = decontaminate.fold(t)
        for k, u in items:
            a = decontaminate.fold(u)
            score = decontaminate.align(a, b)[0] / (2 * len(a))
            if score >= 0.5:
                out[i, k] = score
    return out


def test_decontamination_finds_evenly_spread_edits(spark, make, prose):
    items = [(k, " ".join(prose(20 + k))) for k in range(8)]
    rows = [(i, " ".join(prose(60))) for i in range(10)]
    for k, t in items:
        w = t.split()
        rows.append((1000 * (k + 1), " ".join(x for j, v in enumerate(w) for x in [v, f"between{j}"])))  # no two item words in a row
        for step in (3, 4, 5, 6):
            for at in range(step):
                w = t.split()
                w[at::step] = [f"new{j}" for j in range(len(w[at::step]))]
                rows.append((1000 * (k + 1) + 10 * step + at, " ".join(prose(15) + w + prose(15))))
    rows += [(9000 + i, items[0][1]) for i in range(20)]  # exact copies make the seeds common
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(make(rows), bench).collect()}
    want = all_pairs(rows, items)
    worked = items[0][1].split()
    worked[3::4] = ["new"] * 5
    assert decontaminate.align(decontaminate.fold(items[0][1]), decontaminate.fold(" ".join(worked)))[0] / 40 == 0.65
    assert (1043, 0) in want and (1030, 0) in want and all((1000 * (k + 1), k) in want for k in range(8)) and got == want


def test_decontamination_of_short_and_repeating_items(spark, make, prose):
    items = [(0, "a b c"), (1, "a b c d"), (2, "x x x y x x"), (3, "solo"), (4, "two words"), (5, "m n o p q r s t")]
    rows = [(1, "z a b z"), (2, "z a b q c z"), (3, "a b c"), (4, "a z b c d"), (5, "x x x x x x"), (6, "x y"), (7, "solo two words"),
            (8, "m n o p"), (9, "m n z z o p"), (10, "A, b! (C)")]
    found = decontaminate.matches(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {k for k, s in all_pairs(rows, items[:3] + items[5:]).items() if s * 2 * len(dict(items)[k[1]].split()) >= 6}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and {(3, 0), (10, 0), (3, 1), (4, 1), (5, 2), (8, 5)} <= want


def test_decontamination_of_a_long_text(spark, make, prose):
    items = [(k, " ".join(prose(30))) for k in range(20)]
    long = prose(60_000)
    long[40_000:40_000] = [w for j, w in enumerate(items[7][1].split()) if j % 6]
    found = decontaminate.matches(make([(1, " ".join(long))]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["item_id"], r["start_word"] >= 40_000, r["end_word"] <= 40_030) for r in found] == [(7, True, True)]


def test_decontamination_finds_split_copies(spark, make, prose):
    q = random.Random(6)
    items = [(k, " ".join(prose(40))) for k in range(5)]
    w = items[0][1].split()
    w[10], w[30] = "one", "two"
    rows = [(1, " ".join(prose(50) + w[:20] + prose(30) + w[20:] + prose(50)))]
    for i in range(60):  # insertions of up to an item's length, dropped and changed words
        w = items[i % 5][1].split()
        for _ in range(q.randrange(4)):
            w[q.randrange(len(w))] = "changed"
        for _ in range(q.randrange(4)):
            del w[q.randrange(len(w))]
        for _ in range(q.randint(1, 3)):
            at = q.randrange(len(w))
            w[at:at] = prose(q.randrange(20))
        rows.append((100 + i, " ".join(prose(50) + w + prose(50))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(make(rows), bench).collect()
    want = all_pairs(rows, items)
    assert want[1, 0] == 0.55 and {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want
    text = dict(rows)
    for r in found:
        place = decontaminate.fold(text[r["doc_id"]])[r["start_word"]:r["end_word"]]
        assert decontaminate.align(decontaminate.fold(items[r["item_id"]][1]), place) == (r["score"] * 80, 0, len(place))


def test_repeated_words_of_an_item_are_not_aligned(make, prose, monkeypatch):
    item = [f"w{j}" for j in range(40)]
    block = decontaminate.Items([" ".join(item)], 0.5, 3)
    aligned, best = [], decontaminate._best
    monkeypatch.setattr(decontaminate, "_best", lambda *a: aligned.extend(a[0]) or best(*a))
    text = decontaminate.fold(" ".join(item[:15] * 20))  # 300 words in a row that the item has, but 15 different ones
    assert list(block.scored(text)) == [] and aligned == []
    scattered = decontaminate.fold(" ".join(x for w in item for x in [w, "a", "b", "c"]))  # all of the item, too far apart
    assert list(block.scored(scattered)) == [] and aligned == []
    assert [hit[:2] for hit in block.scored(decontaminate.fold(" ".join(["x"] + item)))] == [(0, 1.0)] and aligned


def test_decontamination_of_common_words_equals_all_pairs(make, spark):
    q = random.Random(8)
    words = [f"v{j}" for j in range(40)]
    items = [(k, " ".join(q.choices(words, k=q.randint(3, 30)))) for k in range(12)]
    rows = [(i, " ".join(q.choices(words + ["other"] * 10, k=q.randint(0, 150)))) for i in range(60)]
    for i in range(60):  # copies with repeated, dropped and added words between texts of the same words
        w = items[i % 12][1].split()
        for _ in range(q.randrange(len(w))):
            w.insert(q.randrange(len(w) + 1), q.choice([*words, "other"])) if q.random() < 0.6 or len(w) < 3 else w.pop(q.randrange(len(w)))
        rows.append((100 + i, " ".join(q.choices(words, k=20) + w + q.choices(words, k=20))))
    rows += [(500, None), (501, ""), (502, items[4][1]), (503, "")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in
           decontaminate.matches(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = all_pairs(rows, items)
    want = {k: s for k, s in want.items() if round(s * 2 * len(items[k[1]][1].split())) >= 6}
    assert got == want and len(want) > 40


def test_texts_of_many_lengths_are_aligned_together(make, prose, spark):
    items = [(k, " ".join(prose(5 + 7 * k))) for k in range(8)]
    rows = [(100 * k + n, " ".join(prose(n) + t.split()[1:] + prose(3 * n))) for k, t in items for n in (0, 1, 50, 400)]
    block = decontaminate.Items([t for _, t in items], 0.5, 3)
    texts = [None, "", *(t for _, t in rows), ""]
    got = [(i, k, start, end) for i, k, _, start, end in block.found(texts)]
    assert sorted(got) == sorted((2 + 4 * k + j, k, n, n + 4 + 7 * k) for k in range(8) for j, n in enumerate((0, 1, 50, 400)))
    assert list(block.found([])) == [] == list(decontaminate.Items([], 0.5, 3).found(["a b c", None]))
