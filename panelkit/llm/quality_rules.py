"""Quality rules combined by weak supervision, in DataFrame operations only.

Each rule votes good (1) or bad (0) on a document, or abstains (null). Votes
are observations of a hidden class: expectation-maximisation estimates the
rules' accuracies from their agreement over all documents, without labels, and
a document is kept if its posterior probability of being good is high enough. A document
that fails one rule can so be kept, and one that passes most can go.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import SPACE, WORD, pick
from panelkit.session import scratch_path

WINDOW = 8

# rule: (class it votes for, when); it abstains elsewhere. Most faults are seen by two rules, so that agreement can tell how far to trust them.
RULES: dict[str, tuple[int, str]] = {
    "symbols": (0, "n_symbols >= 0.02D * word_chars"),
    "symbol_words": (0, "n_symbol_words >= 0.08D * n_words"),
    "shouting": (0, "n_upper >= 0.3D * word_chars"),
    "exclamation": (0, "n_exclaim >= 0.1D * n_words"),
    "repeats": (0, "n_repeat_words >= 0.2D * n_words"),
    "few_kinds": (0, "n_words >= 20 AND n_kinds <= 0.15D * n_words"),
    "dup_lines": (0, "n_dup_lines >= 0.3D * n_lines"),
    "plain": (1, "n_symbol_words <= 0.01D * n_words AND n_exclaim <= 0.01D * n_words AND n_upper <= 0.12D * word_chars"),
    "varied": (1, "n_repeat_words <= 0.05D * n_words AND n_dup_lines <= 0.05D * n_lines"),
}
PRIOR_GOOD = 0.8
# Start of P(rule votes | good), P(rule votes | bad) by the class that the rule votes for.
START = {1: (0.85, 0.3), 0: (0.03, 0.3)}
# Estimates stay between these, so no vote is ever taken as certain.
LOWEST, HIGHEST = 0.001, 0.999
MAX_STEPS = 40
TOLERANCE = 1e-6
KEEP_FROM = 0.5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: inside a lambda, a plain reference would compute it again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words inside windows of ``window`` words that occur at least twice in the array."""

    def of(w: Column) -> Column:
        n = F.size(w)
        name = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])
        names = F.transform(F.sequence(F.lit(0), n - window), name)

        def spread(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            hit = F.filter(F.sequence(F.lit(0), last),
                           lambda i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, F.least(i + 1, last))))
            places = F.sort_array(F.transform(hit, lambda i: F.get(s, i)["i"]))
            return F.aggregate(
                places, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")),
                lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end")),
                lambda a: a["n"])

        def covered(h: Column) -> Column:
            places = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, spread))

        return F.when(n < window, F.lit(0)).otherwise(let(names, covered))

    return let(words, of)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document; a null text has no words and no lines."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    d = d.withColumns({
        "words": F.filter(F.split(t, SPACE), lambda w: w != ""),
        "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
    })
    long = lambda c: c.cast("long")
    return d.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"),
        long(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.array_distinct("words"))).alias("n_kinds"),
        long(F.regexp_count(t, F.lit("[#*$%&|<>]+"))).alias("n_symbol_words"),
        long(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("n_exclaim"),
        long(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("n_upper"),
    )


def votes(m: DataFrame) -> DataFrame:
    """A column ``vote_<rule>`` for each rule: 1 good, 0 bad, null abstains; no words: every rule abstains."""
    return m.withColumns({
        f"vote_{k}": F.expr(f"CASE WHEN n_words > 0 AND ({when}) THEN {label} END") for k, (label, when) in RULES.items()})


def _posterior(prior: float, rates: dict[str, tuple[float, float]]) -> Column:
    """P(good | votes); rates[rule] = (P(it votes | good), P(it votes | bad)). To abstain is evidence too."""
    odds = F.lit(math.log(prior) - math.log(1 - prior))
    for k, (g, b) in rates.items():
        odds = odds + F.when(F.col(f"vote_{k}").isNotNull(), math.log(g) - math.log(b)).otherwise(math.log(1 - g) - math.log(1 - b))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """Expectation-maximisation over the table of vote patterns and their counts ``n``.

    It finds the prior and, for each rule, how often it votes on good and on
    bad documents, which is its accuracy by Bayes' rule. The table has at most
    2 to the power of the number of rules rows, whatever the number of
    documents; each step is one aggregate over it.
    """
    prior, rates = PRIOR_GOOD, {k: START[label] for k, (label, _) in RULES.items()}
    clip = lambda x: min(HIGHEST, max(LOWEST, x))
    for _ in range(MAX_STEPS):
        good = F.col("n") * _posterior(prior, rates)
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for k in RULES:
            voted = F.col(f"vote_{k}").isNotNull()
            sums += [F.sum(F.when(voted, F.col("n")).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(voted, good).otherwise(0.0)).alias(f"good_{k}")]
        r = patterns.agg(*sums).first()
        if not r["n"]:
            break
        bad = max(r["n"] - r["good"], 1e-9)
        new = {k: (clip(r[f"good_{k}"] / max(r["good"], 1e-9)), clip((r[f"n_{k}"] - r[f"good_{k}"]) / bad)) for k in RULES}
        moved = max(abs(a - b) for k in RULES for a, b in zip(new[k], rates[k]))
        prior, rates = clip(r["good"] / r["n"]), new
        if moved < TOLERANCE:
            break
    return prior, rates


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, keep_from: float = KEEP_FROM,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the counts, base_failed, the posterior and kept.

    ``base_failed`` (too few words, or too many of them repeated) overrides the
    posterior. Null text: no words, so base_failed. Null and repeated ids keep
    their rows. A very long text is measured whole, in its row's task. An
    empty table gives an empty result. The counts are written
    once to the shared folder, so the texts are read once.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "quality-measures")
    votes(measures(docs, id_col, text_col)).write.parquet(path)
    m = spark.read.parquet(path)
    names = [f"vote_{k}" for k in RULES]
    patterns_path = scratch_path(spark, "quality-patterns")
    m.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*names).write.parquet(patterns_path)
    prior, rates = estimate(spark.read.parquet(patterns_path))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (_posterior(prior, rates) >= keep_from)).alias("kept"),
        _posterior(prior, rates).alias("p_good"))
