"""Mixing sources to target weights by a splitting tree of exact quotas.

Documents of a source are dealt to blocks by a hash, which also permutes them.
A source gives whole passes over its blocks, then a prefix of the permuted
blocks up to its target. The draws of all sources are divided among the output
shards by a binary tree: each node splits its exact quotas between two halves
of its shards by a multivariate hypergeometric draw. So each shard is a random
sample of the mix with exact totals. ``lay_out`` brings the draws of a shard
into one task, which shuffles them; no step sorts a whole source.

What the driver holds is one row per source and block: at most ``MAX_SOURCES``
plus ``MAX_BLOCKS``, checked, and not more for more data, as blocks grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import WORD, collect_bounded, pick
from panelkit.session import cut_lineage, scratch_path

MAX_SOURCES = 100_000
MAX_BLOCKS = 1 << 20  # of all sources together
MAX_SHARDS = 1 << 16
BROADCAST_BYTES = 32 << 20
BLOCK_WORDS = 50_000
SHARD_WORDS = 5_000_000
FINE = 1_024  # parts of a block, and parts of such a part, in which the last quota is cut


def water_fill(sizes: list[int], weights: list[int], cap: int, share: Fraction = Fraction(1)) -> list[Fraction]:
    """Targets in proportion to the weights, none above cap * size; the excess is reshared until none is above.

    Sources fill up in the order of cap * size by weight, so one pass in that order finds those that do.
    """
    target = [Fraction(0)] * len(sizes)
    left, w = sum(sizes) * share, sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (weights[i] == 0, Fraction(cap * sizes[i], weights[i] or 1)))
    for k, i in enumerate(order):
        if left * weights[i] <= cap * sizes[i] * w:
            for j in order[k:]:
                target[j] = left * weights[j] / (w or 1)
            break
        target[i] = Fraction(cap * sizes[i])
        left -= target[i]
        w -= weights[i]
    return target


def tree_leaves(quota: np.ndarray, shards: int, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, draws of each) by halving the quotas; a node holds only the sources that it has draws of."""
    index = np.flatnonzero(quota)
    todo = [(0, shards, index, quota[index].astype(np.int64))]
    while todo:
        lo, hi, index, q = todo.pop()
        n = int(q.sum())
        if hi - lo == 1 or n == 0:
            yield lo, index, q
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(q, n * (mid - lo) // (hi - lo), method="marginals")
        right = q - left
        todo += [(lo, mid, index[left > 0], left[left > 0]), (mid, hi, index[right > 0], right[right > 0])]


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Shards x sources: how many draws of each source go to each shard; columns add up to the quotas."""
    out = np.zeros((shards, len(quota)), np.int64)
    for shard, index, n in tree_leaves(quota, shards, rng):
        out[shard, index] = n
    return out


def deal(quota: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The shard of each draw of each source, in the order of its draws."""
    leaves = list(tree_leaves(quota, shards, rng))
    index = np.concatenate([i for _, i, _ in leaves])
    n = np.concatenate([n for _, _, n in leaves])
    shard = np.repeat([x for x, _, _ in leaves], [len(i) for _, i, _ in leaves])
    order = np.lexsort((shard, index))
    return np.split(np.repeat(shard[order], n[order]), np.cumsum(quota)[:-1])


@dataclass
class Plan:
    """targets: a row per source; draws: a row per source and block with the shards of its whole draws and the bounds of its last.

    Both are small enough to be broadcast or else joined by their keys.
    """

    targets: DataFrame
    draws: DataFrame
    shards: int
    seed: int


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Source, size in words and place of each document; the place is a hash of id and text, so it does not depend on the file layout."""
    d = pick(docs, doc_id=id_col, text=text_col, src=source_col)
    return d.select("doc_id", *_place(F.col("doc_id"), F.col("text"), F.col("src"), seed))


def _place(doc_id: Column, text: Column, src: Column, seed: int) -> list[Column]:
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)
    return [F.coalesce(src, F.lit("")).alias("s"), src.isNull().alias("s_null"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u")]


def plan_mix(d: DataFrame, weights: list[int], cap: int = 3, seed: int = 7) -> Plan:
    """Quotas, cuts and shards from the sized documents; ``weights`` repeat over the sources in code-point order, null last."""
    spark: SparkSession = d.sparkSession
    totals = collect_bounded(d.groupBy("s", "s_null").agg(F.sum("size").alias("n")), MAX_SOURCES, "sources")
    totals.sort(key=lambda r: (r["s_null"], r["s"]))
    sizes = [int(r["n"]) for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    block_words_aim = max(BLOCK_WORDS, -(-sum(sizes) // MAX_BLOCKS))
    n_blocks = [max(1, -(-n // block_words_aim)) for n in sizes]
    names = [(r["s"], r["s_null"]) for r in totals]
    src = spark.createDataFrame(
        [(s, z, i, b, n, float(t)) for i, ((s, z), b, n, t) in enumerate(zip(names, n_blocks, sizes, targets))],
        "s string, s_null boolean, si int, blocks int, source_size long, target double")
    src = _small(src, sum(64 + 4 * len(s) for s, _ in names))
    placed = _parts(d.join(src, ["s", "s_null"]))

    block_words = [np.zeros(b, np.int64) for b in n_blocks]
    for r in collect_bounded(placed.groupBy("si", "block").agg(F.sum("size").alias("n")), MAX_SOURCES + MAX_BLOCKS, "blocks"):
        block_words[r["si"]][r["block"]] = r["n"]

    # Whole passes, then whole blocks of a permuted order, then a cut inside one block.
    rng = np.random.default_rng(seed)
    passes, order, full, rest = [], [], [], []
    for n, t, words in zip(sizes, targets, block_words):
        e = int(t // n) if n else 0
        perm = rng.permutation(len(words))
        left = round(t - e * n)
        ends = np.cumsum(words[perm])
        q = int(np.searchsorted(ends, left, side="right"))
        passes.append(e)
        order.append(perm)
        full.append(q)
        rest.append(left - (int(ends[q - 1]) if q else 0))
    cut = {i: int(order[i][full[i]]) for i in range(len(sizes)) if full[i] < len(order[i]) and rest[i] > 0}
    bounds = {}
    if cut:
        at = spark.createDataFrame([(i, b, rest[i]) for i, b in cut.items()], "si int, block int, left long")
        inside = placed.join(_small(at, 64 * len(cut)), ["si", "block"])
        mid = cut_lineage(_cut(inside, "part"))
        inside = inside.drop("left").join(_small(mid.select("si", "part", "left"), 64 * len(cut)), ["si", "part"])
        ends = _cut(inside, "fine").select("si", "fine", "left", "n").join(mid.select("si", "part"), "si")
        for r in collect_bounded(ends, MAX_SOURCES, "cuts"):
            bounds[r["si"]] = (r["part"], r["fine"], r["left"], r["n"])

    # Draw k of source i is block order[k % blocks] in pass k // blocks; the tree says how many draws each shard gets.
    quota = np.array([e * len(o) + q + (i in cut) for i, (e, o, q) in enumerate(zip(passes, order, full))], np.int64)
    n_draws = int(quota.sum())
    shards = int(max(1, min(MAX_SHARDS, -(-sum(sizes) // SHARD_WORDS), n_draws)))
    rows = []
    for i, (perm, dealt) in enumerate(zip(order, deal(quota, shards, rng) if n_draws else [])):
        whole: list[list[int]] = [[] for _ in perm]
        for k in range(passes[i] * len(perm) + full[i]):
            whole[int(perm[k % len(perm)])].append(int(dealt[k]))
        for b, shard_list in enumerate(whole):
            last = int(dealt[-1]) if cut.get(i) == b else None
            if shard_list or last is not None:
                rows.append((i, b, shard_list, last, *(bounds[i] if last is not None else (0, 0, 0, 1))))
    draws = spark.createDataFrame(
        rows, "si int, block int, shards array<int>, last_shard int, cut_part int, cut_fine int, cut_words long, cut_of long")
    return Plan(src, _small(draws, 112 * len(rows)), shards, seed)


def _small(df: DataFrame, size: int) -> DataFrame:
    """Marked for a broadcast if its rows, which the driver has just made, are small enough; else it is joined by its key."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _parts(d: DataFrame) -> DataFrame:
    """block, part of the block and part of the part: digits of the hash."""
    b = F.col("blocks").cast("long")
    return d.withColumns({
        "block": (F.col("u") % b).cast("int"),
        "part": F.expr(f"cast((u div blocks) % {FINE} as int)"),
    }).withColumn("fine", (F.shiftright(F.col("u"), 40) % FINE).cast("int"))


def _cut(inside: DataFrame, place: str) -> DataFrame:
    """Of each source the place (at most ``FINE`` of them) in which its ``left`` words end, the words still to take there, and its size."""
    up_to = Window.partitionBy("si").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = inside.groupBy("si", place).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    sums = sums.withColumn("end", F.sum("n").over(up_to))
    return sums.where("end > left AND end - n <= left").select("si", place, (F.col("left") - (F.col("end") - F.col("n"))).alias("left"), "n")


def draw(d: DataFrame, plan: Plan) -> DataFrame:
    """The documents with target, taken and draws: an array of (shard, pass, words) structs; undrawn documents have none.

    A document at the very end of a quota gives only its first words.
    """
    whole = lambda i: F.struct(F.get("shards", i).alias("shard"), i.alias("pass"), F.col("size").alias("words"))
    part = F.when(F.col("last_shard").isNull(), 0).when(F.col("part") < F.col("cut_part"), F.col("size")).when(
        F.col("part") > F.col("cut_part"), 0).when(F.col("fine") < F.col("cut_fine"), F.col("size")).when(
        F.col("fine") > F.col("cut_fine"), 0).otherwise(F.floor(F.col("size") * F.col("cut_words") / F.col("cut_of"))).cast("long")
    n = F.coalesce(F.size("shards"), F.lit(0))
    out = _parts(d.join(plan.targets, ["s", "s_null"])).join(plan.draws, ["si", "block"], "left")
    out = out.withColumn("last_words", part).withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    last = F.struct(F.col("last_shard").alias("shard"), n.alias("pass"), F.col("last_words").alias("words"))
    draws = F.concat(
        F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), whole)).otherwise(F.array()),
        F.when((F.col("last_words") > 0), F.array(last)).otherwise(F.array()))
    return out.withColumn("draws", draws).withColumn(
        "taken", n * F.col("size") + F.col("last_words")).drop(
        "si", "block", "part", "fine", "shards", "last_shard", "cut_part", "cut_fine", "cut_words", "cut_of", "last_words", "blocks")


def mix(docs: DataFrame, weights: list[int], cap: int = 3, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken and its draws (shard, pass, words).

    Size counts words; a null or empty text has size 0 and takes nothing. The
    null source is a source of its own, after all others. Rows with equal id
    and text are equal in all: they share a place, and a cut that falls on
    them takes the same share of each. Hashes decide every choice, so reruns
    agree. An empty table gives an empty result. Only the three named columns
    are read, so others cannot clash; a very long text is a document like any
    other. The sizes are written once to
    the shared folder; the texts are read once.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-sizes")
    sized(docs, seed, id_col, text_col, source_col).write.parquet(path)
    d = spark.read.parquet(path)
    return draw(d, plan_mix(d, weights, cap, seed)).select("doc_id", "size", "source_size", "target", "taken", "draws")


def own_name(name: str, taken: list[str]) -> str:
    """The name, or with ``mix_`` before it (as often as needed) where the input has such a column."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"mix_{name}"
    return name


def mixed_texts(docs: DataFrame, weights: list[int], cap: int = 3, seed: int = 7,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and size, source_size, target, taken and draws.

    A result column whose name the input has already is called ``mix_`` and its
    name, so neither is lost. ``lay_out`` gives a row a draw instead.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-sizes")
    sized(docs, seed, id_col, text_col, source_col).write.parquet(path)
    plan = plan_mix(spark.read.parquet(path), weights, cap, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, *_place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`"), seed))
    out = draw(d, plan).where(F.col("taken") > 0)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns],
                      *[F.col(c).alias(own_name(c, docs.columns)) for c in ("size", "source_size", "target", "taken", "draws")])


def lay_out(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row per draw with all columns of ``docs`` and shard, place, pass, words and row_key.

    A shard is one task; its rows are shuffled by a seeded hash, and place
    counts them from 0. A draw of fewer words than its document has gives those
    first words, joined by one space. A result column whose name the input has
    is called ``mix_`` and its name. row_key is the hash of id and text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, *_place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`"), plan.seed))
    d = draw(d, plan).where("taken > 0").select("row", "size", "u", F.explode("draws").alias("dr"))
    d = d.select("row", "size", "u", "dr.*").withColumn("o", F.xxhash64(F.lit(plan.seed), "shard", "pass", "u"))
    d = d.repartitionById(plan.shards, F.col("shard")).sortWithinPartitions("o", "u", "pass")
    # ids count the rows of a partition from a multiple of 2^33 on
    d = d.withColumn("place", F.monotonically_increasing_id() % (1 << 33)).withColumnRenamed("u", "row_key")
    text = F.col("row").getField(text_col)
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") < F.col("size"), words).otherwise(text)
    return d.select(*[(cut if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns],
                    *[F.col(c).alias(own_name(c, docs.columns)) for c in ("shard", "place", "pass", "words", "row_key")])


def write_mix(docs: DataFrame, path: str, weights: list[int], cap: int = 3, seed: int = 7,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Write the laid-out mix (``lay_out``) as Parquet to ``path``; returns what it took of each input row.

    The result has doc_id, size, source_size, target and taken, the words that
    the written shards hold of the row. Nulls, ties, repeated rows and empty
    tables are as in ``mix``: rows equal in id and text take equal parts of
    what their common key has in the shards.
    """
    spark = docs.sparkSession
    sizes = scratch_path(spark, "mix-sizes")
    sized(docs, seed, id_col, text_col, source_col).write.parquet(sizes)
    d = spark.read.parquet(sizes)
    plan = plan_mix(d, weights, cap, seed)
    lay_out(docs, plan, id_col, text_col, source_col).write.parquet(path)
    laid = spark.read.parquet(path)
    words, key = (F.col(f"`{own_name(c, docs.columns)}`") for c in ("words", "row_key"))
    id_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("id_text")
    # every drawn row has a draw of pass 0, so those count the equal rows behind a key
    equal = F.count_if(F.col(f"`{own_name('pass', docs.columns)}`") == 0)
    took = laid.groupBy(key.alias("u"), id_text(id_col)).agg(F.sum(words).alias("words"), equal.alias("equal"))
    took = took.select("u", "id_text", F.expr("words div equal").alias("taken"))
    rows = d.join(plan.targets, ["s", "s_null"]).withColumn("id_text", id_text("doc_id")).join(took, ["u", "id_text"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
