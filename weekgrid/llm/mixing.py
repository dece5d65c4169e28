"""Mixing sources: temperature weights, then whole blocks of documents in permuted order.

1. *Shares.* Tokens are words; a source's share p is its part of all tokens. A null source is a source of its own.
2. *Temperature.* Weights are p**a, normalised, with 0 <= a <= 1. The exponent is bisected: to the largest a whose
   entropy still reaches the target, or to the smallest a at which no source is repeated more than the limit. Both measures are monotonous in a. One job over the source table evaluates several levels of the
   bisection at once.
3. *Budget.* By default the smallest one that gives every source at least one whole epoch, so no document is lost.
   A source's target is its weight's part of the budget, and its repetition target / tokens.
4. *Blocks.* A source's documents are dealt by a digest of their id into at most `blocks` blocks. Each epoch runs
   through the source's blocks in an order of its own. Whole epochs are taken entirely, the last one by blocks as long
   as at least half of the next block fits the target. Inside a block, documents have a place of their own in each
   epoch.

The plan has a row per source, block and epoch: with `blocks` and the repetition limit fixed it grows with the sources
only, and windows run over the blocks of one source, never over its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrid.operators.staging import staged



def _digest(*parts: Column | int) -> Column:
    """A number of 32 bits from the parts' text; a null counts as empty."""
    text = F.concat_ws(":", *(F.coalesce((F.lit(x) if isinstance(x, int) else x).cast("string"), F.lit("")) for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """By exponent: the entropy of the weights, and how often the most repeated source is repeated.

    A source's repetition, at the budget that gives every source one epoch, is (p_max / p) ** (1 - a) at most.
    """
    rows = (
        shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .withColumn("q", F.exp(F.col("a") * F.log("p")))
        .groupBy("a")
        .agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("a") * F.log("p")).alias("s"), F.max("p").alias("hi"), F.min("p").alias("lo"))
        .select("a", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), F.exp((1 - F.col("a")) * F.log(F.col("hi") / F.col("lo"))).alias("most"))
    )
    return {r["a"]: (r["entropy"], r["most"]) for r in rows.collect()}  # one row an exponent


def bisect(shares: DataFrame, entropy: float | None, repetition: float | None, halvings: int = 40, at_once: int = 4) -> float:
    """The exponent: the largest with at least `entropy` (nats), or else the smallest with at most `repetition`.

    An entropy that even equal weights do not reach gives 0, one that the shares already have gives 1; a repetition
    limit below 1 gives 1.
    """
    met = (lambda m: m[0] >= entropy) if entropy is not None else (lambda m: m[1] > repetition)
    low, high = 0.0, 1.0
    ends = _measures(shares, [low, high])
    if not ends or (entropy is not None and met(ends[high])):
        return 1.0
    if not met(ends[low]):
        return 0.0
    for _ in range(halvings // at_once):
        parts = 1 << at_once
        grid = [low + (high - low) * i / parts for i in range(parts + 1)]
        found = _measures(shares, grid[1:-1])
        # met holds up to a point: the bracket is the last that meets it and the one after.
        last = max([0, *(i for i in range(1, parts) if met(found[grid[i]]))])
        low, high = grid[last], grid[last + 1]
    return low if entropy is not None else high


def mixing_plan(
    counted: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, seed: int = 0
) -> DataFrame:
    """(source_key, block, epoch, weight, repetition, alpha) of the blocks to take, from (source_key, block, tokens)."""
    if (entropy is None) == (repetition is None):
        raise ValueError("give a target entropy or a repetition limit")
    blocks = staged(counted.groupBy("source_key", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    per_source = blocks.groupBy("source_key").agg(F.sum("tokens").alias("source_tokens"))
    whole = per_source.agg(F.sum("source_tokens")).first()[0] or 0
    sources = staged(per_source.where("source_tokens > 0").withColumn("p", F.col("source_tokens") / F.lit(float(max(1, whole)))), "sources")
    alpha = bisect(sources, entropy, repetition)
    weighed = sources.withColumn("q", F.exp(F.lit(alpha) * F.log("p")))
    z, least = weighed.agg(F.sum("q"), F.max(F.col("source_tokens") / F.col("q"))).first()
    total = float(budget) if budget is not None else (least or 0.0) * (z or 0.0)
    weight = F.coalesce(F.col("q") / F.lit(z or 1.0), F.lit(0.0))
    # A source without tokens costs nothing and is taken once.
    times = F.when(F.col("source_tokens") > 0, F.col("weight") * F.lit(total) / F.col("source_tokens")).otherwise(1.0)
    planned = (
        per_source.join(weighed.select("source_key", "q"), "source_key", "left")
        .select("source_key", "source_tokens", weight.alias("weight"))
        .withColumn("repetition", times)
    )
    # A hair above a whole number is that number.
    whole_epochs = F.floor(F.col("repetition") + F.lit(1e-6))
    epochs = F.greatest(F.ceil(F.col("repetition") - F.lit(1e-6)), F.lit(1))
    taken = blocks.join(planned, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs.cast("int"))))
    order = Window.partitionBy("source_key", "epoch").orderBy(_digest(seed, F.col("epoch"), F.col("block")), "block")
    until = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    need = (F.col("repetition") - F.col("epoch") + 1) * F.col("source_tokens")
    fits = (F.col("epoch") <= whole_epochs) | (F.col("until") - F.col("tokens") / 2 <= need)
    kept = taken.withColumn("until", until).where(fits)
    return kept.select("source_key", "block", "epoch", "weight", "repetition", F.lit(alpha).alias("alpha"))


def mix(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, blocks: int = 64, seed: int = 0
) -> DataFrame:
    """The rows of `docs` as often as the plan takes them, with a struct `_mix`: epoch, block, place, weight, repetition, alpha.

    Ordered by epoch, block order and place the rows are the mixture's stream; they come unordered. Sources without a
    token (empty or null texts only) have no weight and are taken once. Null doc_ids share a block; repeated rows are
    rows like any other. An empty table stays empty.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    block = (_digest(seed, F.col("doc_id")) % F.lit(blocks)).cast("int")
    counted = docs.select(key.alias("source_key"), block.alias("block"), tokens(F.col("text")).alias("tokens"))
    plan = staged(mixing_plan(counted, entropy, repetition, budget, seed), "mixing-plan")
    names = docs.columns
    dealt = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), key.alias("source_key"), block.alias("block"))
    place = _digest(seed, F.col("epoch"), F.col("_row.doc_id"))
    mixed = F.struct("epoch", "block", place.alias("place"), "weight", "repetition", "alpha")
    return dealt.join(plan, ["source_key", "block"]).select(*(F.col(f"_row.`{c}`").alias(c) for c in names), mixed.alias("_mix"))
