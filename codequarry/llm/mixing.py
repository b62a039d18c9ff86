"""Mixing sources to target shares of tokens (problem 9).

A low-discrepancy schedule: slot ``i`` takes the golden-ratio point
``frac((i + 1) * phi)``, the cumulative weights of the sources tell which source the
point falls on, and slots are ranked per source. Each source's documents are
shuffled by a hash and laid end to end, once per allowed repetition; the laid-out
tokens are cut into blocks of equal size, and the r-th slot of a source takes its
r-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tokens import once, token_counts
from codequarry.session import staged

#: frac(golden ratio), the step of the sequence with the most even spread.
GOLDEN = 0.6180339887498949
#: Documents of a hash range, on average, and the fewest ranges. A source's shuffled documents are summed range by range, so its running total needs no single task.
RANGE_DOCS, LEAST_RANGES = 20_000, 16


def _name(col: str) -> Column:
    r"""Sources are compared after trimming white space and lower-casing."""
    return F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", ""))


def plan_mixture(docs: DataFrame, targets: DataFrame, block_tokens: int = 256, id_col: str = "doc_id", seed: int = 17, **tokenizer: str) -> DataFrame:
    """``slot, source, block, doc_id, repeat, tokens``: the mixture, document by document, in order of ``slot``.

    ``docs`` has ``id_col, text, source``; ``targets`` has ``source, target_share,
    max_repeats``. The mixture is as large as the scarcest source allows, used
    ``max_repeats`` times. A document stands, whole, in the slot its
    first token falls in: blocks are equal stretches of the laid-out tokens, and what
    the documents of a slot hold together differs from a block by parts of documents.
    No document comes more than ``max_repeats`` times. Documents without tokens
    (null, empty), of null sources or of sources without a target take no part.
    Targets that repeat a source count once (the largest share); shares that are
    null or not positive, or repeats below 1, leave the source out; the rest is
    scaled to add up to 1. Equal ids count once (the greatest source and text).
    """
    spark = docs.sparkSession
    goals = (
        targets.select(_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
        .filter("source is not null and share > 0 and most >= 1")
        .groupBy("source")
        .agg(F.max("share").alias("share"), F.max("most").alias("most"))
    )
    one = once(docs.select(F.col(id_col).cast("long").alias("id"), _name("source").alias("source"), "text"))
    wanted = one.join(F.broadcast(goals.select("source")), "source", "left_semi")
    sized = wanted.select("id", "source").join(token_counts(wanted, "id", "text", distinct=True, **tokenizer), "id").filter("tokens > 0")
    sized = staged(sized.withColumn("order", F.xxhash64("id", F.lit(seed))), "sized")
    ranges = max(LEAST_RANGES, sized.count() // RANGE_DOCS)
    sized = sized.withColumn("range", F.pmod(F.shiftright("order", 32), F.lit(ranges)).cast("int"))

    # One row a source and range.
    sums = sized.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("start", before).drop("n")
    stock = {r["source"]: (r["tokens"], r["share"], r["most"]) for r in sums.groupBy("source").agg(F.sum("n").alias("tokens")).join(goals, "source").collect()}
    schema = "slot long, source string, block long, doc_id long, repeat int, tokens long"
    if not stock:
        return spark.createDataFrame([], schema).withColumnRenamed("doc_id", id_col)
    whole = sum(share for _, share, _ in stock.values())
    total = min(tokens * most * whole / share for tokens, share, most in stock.values())
    slots = max(1, int(total // block_tokens))
    # A source's slots are spaced evenly within one, so its blocks are as many as its share of all slots asks for.
    low, cuts = 0.0, []
    for source, (tokens, share, most) in sorted(stock.items()):
        cuts.append((source, low, low + share / whole, tokens, min(most, int(total * share / whole / tokens) + 2)))
        low += share / whole
    weights = spark.createDataFrame(cuts, "source string, low double, high double, stock long, most int")

    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    schedule = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", point - F.floor(point))
    on = (F.col("x") >= F.col("low")) & ((F.col("x") < F.col("high")) | ((F.col("x") >= F.lit(low)) & (F.col("high") >= F.lit(low))))
    schedule = schedule.join(F.broadcast(weights), on).withColumn("part", F.floor(F.col("slot") / 65_536))
    # Ranks within parts of 65,536 slots, plus the slots of the parts before.
    parts = schedule.groupBy("source", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = schedule.join(parts.withColumn("ahead", ahead).drop("n"), ["source", "part"]).withColumn(
        "block", F.row_number().over(Window.partitionBy("source", "part").orderBy("slot")) - 1 + F.col("ahead")
    )

    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Sums are partitioned like the ranges they belong to, so the join needs no further shuffle of the documents.
    laid = sized.withColumn("inside", inside).join(starts.repartition("source", "range"), ["source", "range"])
    laid = laid.join(F.broadcast(weights.select("source", "stock", "most")), "source")
    laid = laid.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("most"))))
    first = F.col("start") + F.col("inside") + (F.col("repeat") - 1) * F.col("stock")
    blocks = laid.select("source", F.floor(first / block_tokens).alias("block"), "id", "repeat", "tokens")
    return blocks.join(ranked.select("slot", "source", "block"), ["source", "block"]).select("slot", "source", "block", F.col("id").alias(id_col), "repeat", "tokens")


def reached_shares(mixture: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``source, target_share, tokens, share, documents, most_used``: what a mixture reached, one row a target; sources without documents have 0."""
    used = mixture.groupBy("source", id_col).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    per = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("n").alias("most_used"))
    goals = targets.select(_name("source").alias("source"), "target_share").groupBy("source").agg(F.max("target_share").alias("target_share"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tokens", "documents", "most_used")]
    return goals.join(per, "source", "left").withColumn("share", F.coalesce(F.col("tokens") / all_tokens, F.lit(0.0))).select("source", "target_share", "share", *zero)
