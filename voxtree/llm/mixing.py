"""Sources mixed to target shares of the tokens.

Each document has a place between 0 and 2^36 by a hash of its id. Tokens are summed by source and range
of places; prefix sums over the ranges give the one in which a source's budget ends, only that range is
summed again in finer ranges, and so on to single places. A document then belongs to the mixture if its
place is below its source's threshold, which needs no sort and no second shuffle; a smaller budget gives
a smaller threshold and so a subset. Sources that are smaller than their budget are taken whole as often
as it holds them, and once more below the threshold.

Without a total the mixture is as large as the caps on repeats allow while all shares are met. The
sizes are computed once and written to the shared folder.

Defined results: sources that are not listed, a null source among them, and documents without tokens are
not in the mixture; a listed source without documents has share 0 and the other weights are scaled to
sum to 1; null or non-positive weights and caps leave a source out; of several rows of one source the
largest weight and cap count; documents with one id share a place, and are taken or left together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtree.llm.tokens import TOKENIZER, token_sizes
from voxtree.session import materialize

#: Bits of a place that each round decides, and rounds.
STEP, ROUNDS = 12, 3


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.where("source_name is not null").groupBy(F.col("source_name").alias("source"))
        .agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    )


def _budgets(sizes: DataFrame, total_tokens: float | None) -> DataFrame:
    """source, available, budget, whole (full repeats) and rest (tokens beyond them); as many rows as
    listed sources."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.first("target_weight").alias("weight"), F.first("max_repeats").alias("cap"))
    everything = Window.partitionBy()
    shared = have.withColumn("share", F.col("weight") / F.sum("weight").over(everything))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("available") * F.col("cap") / F.col("share")).over(everything)
    budget = F.least(F.col("share") * total, (F.col("available") * F.col("cap")).cast("double"))
    return (
        shared.withColumn("budget", budget).withColumn("whole", F.floor(F.col("budget") / F.col("available") + 1e-12).cast("int"))
        .withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("available"), F.lit(0.0)))
        .select("source", "available", "budget", "whole", "rest")
    )


def _thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, whole and threshold."""
    bounds = budgets.select("source", "whole", "rest", F.lit(0).cast("bigint").alias("prefix"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, ROUNDS + 1):
        left = STEP * (ROUNDS - k)
        here = sizes.join(bounds, "source").where(F.shiftright("place", left + STEP) == F.col("prefix"))
        sums = here.groupBy("source", F.shiftright("place", left).alias("range")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
        cut = (
            sums.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).where("below + n > rest")
            .groupBy("source").agg(F.min_by(F.struct("range", (F.col("rest") - F.col("below")).alias("rest"), "n"), "range").alias("b"))
        )
        # a budget that ends beyond all ranges of the prefix ends with them
        past = (F.col("prefix") + 1) * 2**STEP
        bounds = materialize(
            bounds.withColumnRenamed("rest", "_rest").join(cut, "source", "left").select(
                "source", "whole", F.coalesce("b.rest", F.lit(0.0)).alias("rest"), F.coalesce("b.range", past).alias("prefix"), F.col("b.n").alias("last")
            )
        ).select("source", "whole", "rest", "prefix", *(["last"] if k == ROUNDS else []))
    # the last place is taken when that comes nearer to the budget
    nearer = (F.col("last").isNotNull()) & (F.col("rest") * 2 > F.col("last"))
    return bounds.select("source", "whole", (F.col("prefix") + nearer.cast("bigint")).alias("threshold"))


def _sizes(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    listed = _targets(targets).where("target_weight > 0 and max_repeats > 0")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 64 - STEP * ROUNDS)
    known = documents.select("doc_id", "source", "text").join(listed, "source")
    counted = token_sizes(known, tokenizer, False, "doc_id", "source", "target_weight", "max_repeats")
    return materialize(counted.where("n_tokens > 0").withColumn("place", place))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens, repeats of the documents in the mixture."""
    sizes = _sizes(documents, targets, tokenizer)
    return _mixed(sizes, _budgets(sizes, total_tokens))


def _mixed(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    limits = _thresholds(sizes, materialize(budgets))
    repeats = F.col("whole") + (F.col("place") < F.col("threshold")).cast("int")
    return sizes.join(limits, "source").withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def mixture_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Of every listed source: target_weight, max_repeats, available_tokens, budget_tokens,
    reached_tokens, reached_share, most_repeats."""
    sizes = _sizes(documents, targets, tokenizer)
    budgets = materialize(_budgets(sizes, total_tokens))
    reached = _mixed(sizes, budgets).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached"), F.max("repeats").alias("most_repeats"))
    total = F.sum("reached_tokens").over(Window.partitionBy())
    rows = _targets(targets).join(budgets, "source", "left").join(reached, "source", "left").select(
        "source", "target_weight", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_tokens"), F.coalesce("budget", F.lit(0.0)).alias("budget_tokens"),
        F.coalesce("reached", F.lit(0)).alias("reached_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return rows.withColumn("reached_share", F.when(total > 0, F.col("reached_tokens") / total))
