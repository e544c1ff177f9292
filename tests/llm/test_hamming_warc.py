"""SimHash links against all pairs, and archives as round trips."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import hamming, warc


def fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits):
    """Smallest index in reach of each row, by all pairs."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= bits and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_near_duplicates_equal_all_pairs(make, prose):
    r = random.Random(8)
    base = prose(400, seed=3)
    rows = [(50 - i, " ".join(prose(60))) for i in range(30)]
    for i in range(25):
        x = list(base)
        for _ in range(r.randint(0, 3)):
            x[r.randrange(len(x))] = f"E{i}"
        rows.append((100 + i, " ".join(x)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "One Two"), (204, "one two"), (100, rows[30][1])]
    got = {(x["doc_id"], x["fingerprint"]): x["component_id"] for x in hamming.near_duplicates(make(rows)).collect()}
    fps = [fingerprint(t) for _, t in rows]
    root = classes(fps, 4)
    least = {}
    for (i, _), c in zip(rows, root):
        least[c] = min(least.get(c, i), i)
    assert got == {(i, f"{f:016x}"): least[c] for (i, _), f, c in zip(rows, fps, root)}


def test_very_long_text_has_the_fingerprint_of_all_its_shingles(prose):
    text = " ".join(prose(70_000))  # more shingles than are hashed at once
    whole = hamming._fingerprint(text, 4) & (1 << 64) - 1
    assert whole == fingerprint(text) & (1 << 64) - 1
    assert whole == hamming._fingerprint(text, 4, at_once=999) & (1 << 64) - 1


def test_null_ids_name_no_component(make, prose):
    t = " ".join(prose(40))
    got = [(r["doc_id"], r["component_id"]) for r in hamming.near_duplicates(make([(None, t), (3, t), (None, "other words here now")])).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (3, 3), (None, None)], key=str)
    assert hamming.near_duplicates(make([])).count() == 0


def test_links_connect_planted_clusters(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(8):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            fps.append(f)  # chains
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = hamming.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()
    at = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in links:
        a, b = find(at[x["a"]]), find(at[x["b"]])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == classes(fps, 4)
    assert len(links) <= 4 * len(fps) * hamming.VIEWS


def test_tree_routes_every_close_value():
    weight = np.random.default_rng(1).integers(0, 3, 1 << hamming.BLOCK)
    t = hamming.VantageTree(weight, 500, 1)
    for v in (0, 1, 77, 65_535, 40_000):
        asked = set(t.asks[t.first[v]:t.first[v + 1]].tolist())
        assert t.own[v] in asked and {int(t.own[v ^ (1 << b)]) for b in range(hamming.BLOCK)} <= asked


PAGES = "page_id long, url string, html string, payload string, id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "q") for r in rows], PAGES)


def test_archives_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 300 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/ b\nc", same), (2, "http://b", same), (9, None, same), (1, "u", "x" * 90_000), (4, "u", None), (3, "u", ""),
            (2, "http://b", same), (None, "n", same), (None, "n", "alone")]
    for compress in (False, True):
        path = str(tmp_path / f"w{compress}")
        warc.write_pages(pages(spark, rows), path, compress=compress)
        got = [tuple(r) for r in warc.read_pages(spark, path).collect()]
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            to = first.get(h or "", i)
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
        assert sorted(got, key=str) == sorted(want, key=str)
        full = spark.read.format("warc").load(path).where("record_type = 'response'").select("payload", "payload_digest", "payload_bytes").collect()
        assert all(warc.digest(bytes(r["payload"])) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"] for r in full)


def test_predicates_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(pages(spark, [(1, "u", "a"), (2, "u", "a"), (3, "v", "b")]), path)
    df = spark.read.format("warc").load(path).where("record_type = 'revisit' AND target_uri = 'u'")
    assert [r["record_id"] for r in df.select("record_id").collect()] == ["urn:page:2"]
    reader = warc.WarcReader(path, ["record_id"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == [("record_type", {"revisit"})]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows == [("urn:page:2",)]


def test_empty_and_small_pages(spark, tmp_path):
    warc.write_pages(pages(spark, []), str(tmp_path / "e"))
    assert warc.read_pages(spark, str(tmp_path / "e")).count() == 0
    warc.write_pages(pages(spark, [(1, "u", "a"), (2, "u", "a")]), str(tmp_path / "s"), min_bytes=2)
    assert {r["record_type"] for r in warc.read_pages(spark, str(tmp_path / "s")).collect()} == {"response"}


def test_skipped_payloads_stay_packed(spark, tmp_path):
    r = random.Random(3)
    long = "".join(chr(r.randrange(0x20, 0x3000)) for _ in range(400_000))
    rows = [(1, "u", long), (2, "v", "a"), (3, "w", long + "x"), (4, None, None), (5, "u", "")]
    data = b"".join(warc.member(warc.record(f"urn:page:{i}", u, (t or "").encode())) for i, u, t in rows)
    assert gzip.decompress(data) == b"".join(warc.record(f"urn:page:{i}", u, (t or "").encode()) for i, u, t in rows)
    for columns, all_read in ((["record_id", "payload_bytes"], False), (["record_id", "payload"], True)):
        f = warc.Members(io.BytesIO(data))
        got = list(warc.WarcReader("", columns)._records(f, f.skip))
        assert [x[0] for x in got] == [f"urn:page:{i}" for i, _, _ in rows]
        want = [(t or "").encode() for _, _, t in rows]
        assert [x[1] for x in got] == (want if all_read else [len(t) for t in want])
        assert (f.inflated > 1_000_000) == all_read and (all_read or f.inflated < 10_000)
    # members without lengths, and a file cut off inside one
    plain = b"".join(gzip.compress(warc.record(f"urn:page:{i}", u, (t or "").encode())) for i, u, t in rows)
    f = warc.Members(io.BytesIO(plain + data))
    assert [x[0] for x in warc.WarcReader("", ["payload_bytes"])._records(f, f.skip)] == 2 * [len((t or "").encode()) for _, _, t in rows]
    f = warc.Members(io.BytesIO(plain[:1_000]))
    with pytest.raises(EOFError):
        list(warc.WarcReader("", ["payload_bytes"])._records(f, f.skip))
    path = str(tmp_path / "w")
    warc.write_pages(pages(spark, rows), path, compress=True)
    plan = warc.read_pages(spark, path)._jdf.queryExecution().toString()
    assert "payload_digest" in plan and "payload#" not in plan


def test_predicate_skips_packed_records(spark, tmp_path):
    path = str(tmp_path / "p")
    warc.write_pages(pages(spark, [(i, "u", "same " * 50_000) for i in range(6)] + [(9, "v", "b")]), path, compress=True)
    got = spark.read.format("warc").load(path).where("record_type = 'response'").select("record_id", F.length("payload").alias("n")).collect()
    assert sorted((r["record_id"], r["n"]) for r in got) == [("urn:page:0", 250_000), ("urn:page:9", 1)]


def test_large_shards_are_split_without_loss(monkeypatch):
    r = np.random.default_rng(4)
    n = 1_500
    fp = r.integers(0, 1 << 48, n, dtype=np.uint64) << np.uint64(16)
    for k in range(300):  # planted pairs with four differing bits anywhere in the other blocks
        flips = np.uint64(sum(1 << int(b) for b in 16 + r.choice(48, 4, replace=False)))
        fp[n - 1 - k] = fp[k] ^ flips
    asks = np.concatenate([fp ^ np.uint64(1), fp[:5], fp[:5]])
    both, stored = np.concatenate([asks, fp]), np.arange(len(asks) + n) >= len(asks)
    want = hamming.shard_links(both, stored, 4)
    monkeypatch.setattr(hamming, "DEEP_PAIRS", 20_000)
    monkeypatch.setattr(hamming, "DEEP_POINTS", 64)
    monkeypatch.setattr(hamming, "DEEP_ROWS", 4_000)
    got = hamming.deep_links(both, stored, 4, [1, 2, 3])
    assert len(want[0]) > 1_500 and all(np.array_equal(a, b) for a, b in zip(want, got))
    assert not len(hamming.deep_links(both[:0], stored[:0], 4, [1, 2, 3])[0])
