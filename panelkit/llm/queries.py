"""Registered queries of the text operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.mixing import write_mix
    from panelkit.session import scratch_path

    return write_mix(table(spark, sf_dir, "documents"), scratch_path(spark, "mix-shards"), weights=[5, 2, 1])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm import crf
    from panelkit.llm.common import held_out

    docs = table(spark, sf_dir, "documents")
    found = crf.quality(docs, crf.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "score", "predicted", "good_share")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm import warc
    from panelkit.session import scratch_path

    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path, min_bytes=0, compress=True)
    return warc.read_pages(spark, path)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.suffixes import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.passages import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm import langid
    from panelkit.llm.common import held_out

    docs = table(spark, sf_dir, "documents")
    found = langid.language(docs, langid.fit(docs))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelkit.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.hamming import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelkit.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end=1)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.periodic import periodic_runs, turn_of

    docs = table(spark, sf_dir, "documents")
    return periodic_runs(docs, turn=turn_of(docs["doc_id"]))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k: v for k, v in sorted(globals().items()) if k.startswith("op") and callable(v)
}

# Base32 digits of a SHA-1 in hexadecimal: digit i is the five bits from bit 5 i on, which lie in two neighbouring hex digits.
_HEX = "strpos('0123456789abcdef', substr(x, CAST({} AS BIGINT), 1)) - 1"
_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((("
           + _HEX.format("(5 * i) // 4 + 1") + ") * 16 + " + _HEX.format("(5 * i) // 4 + 2") + ") >> (3 - (5 * i) % 4)) & 31) AS BIGINT), 1)), '')")

ORACLE: dict[str, str] = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (t)""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
g AS (SELECT x.doc_id, list_distinct(flatten(list(range(k, k + 50)))) AS gone FROM x JOIN m USING (s) WHERE least < x.doc_id GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda v, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
}
