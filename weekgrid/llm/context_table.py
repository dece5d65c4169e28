"""The byte model's context trie as tables of (run, n), one per order, over all training texts.

A run is a context of k bytes and a symbol, as a big-endian number of k+1 bytes. Nothing is left out of the counts: those
of shorter runs are sums over all longer ones that end with them. What `ppm.train` works out per context and symbol is
worked out here for the distinct runs of the texts only, level by level: a run that training never met asks for the run
without its oldest byte. Every join is on a run or a context, which at most 256 rows of the level above share, so no key
is hot; no table of a level comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrid.operators.staging import staged


def _tail(key: Column, size: int) -> Column:
    """The last `size` bytes."""
    return key.bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def levels(trained: DataFrame, order: int) -> list[DataFrame]:
    """For each order the trained runs (key, n)."""
    out = [trained]
    for k in range(order - 1, -1, -1):
        shorter = out[0].groupBy(_tail(F.col("key"), k + 1).alias("key")).agg(F.sum("n").alias("n"))
        out.insert(0, staged(shorter, f"runs-{k}"))
    return out


def contexts(runs: list[DataFrame]) -> list[DataFrame]:
    """For each order (context, t, q, t_left, q_left).

    t symbols followed the context, q different ones; the next shorter context was followed by t_left symbols that this
    one was not followed by, q_left different ones.
    """
    out = []
    for k, level in enumerate(runs):
        if k == 0:
            met = level.groupBy(_context(F.col("key")).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("q"))
            met = met.withColumns({"t_left": F.lit(0).cast("long"), "q_left": F.lit(0).cast("long")})
        else:
            below = runs[k - 1].select(F.col("key").alias("low"), F.col("n").alias("n_low"))
            both = level.withColumn("low", _tail(F.col("key"), k)).join(below, "low")
            met = both.groupBy(_context(F.col("key")).alias("context")).agg(
                F.sum("n").alias("t"), F.count("*").alias("q"), F.sum("n_low").alias("t_low")
            )
            shorter = out[-1].select(F.col("context").alias("short"), F.col("t").alias("t_all"), F.col("q").alias("q_all"))
            met = met.withColumn("short", _tail(F.col("context"), k - 1)).join(shorter, "short").select(
                "context", "t", "q", (F.col("t_all") - F.col("t_low")).alias("t_left"), (F.col("q_all") - F.col("q")).alias("q_left")
            )
        out.append(staged(met, f"contexts-{k}"))
    return out


def chances(asked: DataFrame, order: int) -> DataFrame:
    """`asked` (key, n, m: distinct runs of order+1 bytes, how often training and all texts have them) with `chance`.

    `chance` is the symbol's log10 probability after its context: method D with exclusion, as `ppm` says.
    """
    runs = levels(asked.where("n > 0").select("key", "n"), order)
    known = contexts(runs)
    wanted = [asked]
    for k in range(order - 1, -1, -1):
        shorter = wanted[0].where("n = 0").select(_tail(F.col("key"), k + 1).alias("key")).distinct()
        looked_up = shorter.join(runs[k], "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
        wanted.insert(0, staged(looked_up, f"wanted-{k}"))

    met = F.col("n") > 0
    share = lambda n, t: F.log10((F.col(n) - F.lit(0.5)) / F.col(t))
    escape = lambda q, t: F.when(F.col(t) > 0, F.log10(F.col(q) / (2 * F.col(t)))).otherwise(F.lit(0.0))
    below = None
    for k, level in enumerate(wanted):
        found = level.withColumn("context", _context(F.col("key"))).join(known[k], "context", "left").na.fill(0, ["t", "q", "t_left", "q_left"])
        if below is None:
            rest = -F.log10(F.greatest(F.lit(1), F.lit(256) - F.col("q")))
        else:
            # `rest`: after an escape, the symbols that followed the context excluded. Where the context is not known
            # nothing is excluded and the shorter one decides alone.
            lower = below.select(
                F.col("key").alias("low"), F.col("n").alias("n_low"), F.col("chance").alias("chance_low"), F.col("rest").alias("rest_low")
            )
            found = found.withColumn("low", F.when(~met, _tail(F.col("key"), k))).join(lower, "low", "left")
            rest = F.when(F.col("t") == 0, F.col("chance_low")).when(F.col("n_low") > 0, share("n_low", "t_left"))
            rest = rest.otherwise(escape("q_left", "t_left") + F.col("rest_low"))
        valued = found.withColumn("rest", F.when(~met, rest))
        below = valued.withColumn("chance", F.when(met, share("n", "t")).otherwise(escape("q", "t") + F.col("rest")))
        below = below.select(*level.columns, "chance", *(["rest"] if k < order else []))
    return below.select("key", "m", "chance")
