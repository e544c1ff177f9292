"""The pipeline's stages, each judged on its own input."""

import pytest

import corpus_pipeline
from panelkit.llm import stages
from panelkit.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, SF).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_columns(spark, steps):
    columns = table(spark, SF, "documents").columns
    assert all(c == columns for _, _, c in steps[:-1]) and steps[-1][2][:5] == columns


def test_classifier_keeps_clean_rows_and_drops_rejected_ones(spark, steps):
    before, after, _ = steps[0]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    bad = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_row_of_each_group_stays(spark, steps, make):
    from test_hamming_warc import classes, fingerprint

    before, after, _ = steps[1]
    before = sorted(before, key=lambda r: r["doc_id"])
    root = classes([fingerprint(r["text"]) for r in before], 4)
    assert sorted(r["doc_id"] for r in after) == sorted(before[i]["doc_id"] for i in set(root))


def test_repeats_are_cut(spark, steps):
    before, after, _ = steps[2]
    text = {r["doc_id"]: r["text"] for r in after}
    count = {}
    for r in before:
        x = r["text"].encode()
        for k in range(len(x) - 199):
            count[x[k:k + 200]] = count.get(x[k:k + 200], 0) + 1
    for r in before:
        x = r["text"].encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if count[x[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        assert text[r["doc_id"]] == bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", "replace")


def test_contaminated_rows_go(spark, steps):
    before, after, _ = steps[3]
    items = [r["text"].lower() for r in table(spark, SF, "benchmark").collect()]
    whole = {r["doc_id"] for r in before if any(t in r["text"].lower() for t in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert whole <= gone and len(gone) <= len(whole) + 2


def test_mix_takes_near_targets(steps):
    before, after, _ = steps[4]
    taken, target = {}, {}
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 4 for s in taken)
    assert all(r["taken"] > 0 for r in after) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[-1][1])


def test_null_ids_and_extra_columns_in_stages(spark, make, prose):
    t = " ".join(prose(60))
    docs = make([(1, t), (2, t), (None, t), (None, None), (3, " ".join(prose(40))), (3, " ".join(prose(40)))])
    out = stages.simhash_near_dedup(spark, docs, SF)
    # the two rows with id 3 have texts of their own, the null-id copy of document 1 goes
    assert out.columns == docs.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 3, 3, None]
    assert stages.benchmark_decontamination(spark, docs, SF).count() == 6
    mixed = stages.mix_sources(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "mix_size", "source_size", "target", "taken", "draws"]
    assert {(r["size"], r["mix_size"] > 0) for r in mixed.collect()} == {("y", True)}


def test_repeated_and_null_ids_lose_no_text_and_keep_no_copy(spark, make, prose):
    t, own, other, nameless, near = (" ".join(prose(n)) for n in (60, 40, 45, 50, 300))
    rows = [(1, t), (2, t), (3, t), (3, own), (3, other), (3, other), (7, near), (None, near + " more"), (8, None)]
    rows += [(None, t)] * 5 + [(None, nameless)] * 5 + [(None, nameless, "de")] + [(None, "")] * 3
    want = sorted([(1, t), (3, own), (3, other), (7, near), (8, None), (None, nameless)], key=str)
    for order in (rows, rows[::-1]):
        out = stages.simhash_near_dedup(spark, make(order).repartition(5), SF)
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    assert stages.simhash_near_dedup(spark, make([]), SF).count() == 0
