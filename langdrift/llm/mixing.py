"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small_values, written

#: Words stand between white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A plan of at most so many sources is broadcast; a longer one is joined on the source.
BROADCAST_SOURCES = 100_000
#: Exponents tried in one pass over the sources, and passes: 32 ** 12 steps between 0 and 1.
TRIED, PASSES = 32, 12


def source_key(source: Column) -> Column:
    """A source's name that is never null and tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def power_sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent e the sums of p^e and of p^e * ln(p) over the shares p, in one pass."""
    sums = [F.sum(f(F.pow("share", F.lit(e)))) for e in exponents for f in (lambda x: x, lambda x: x * F.log("share"))]
    row = shares.agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()
    return list(zip(row[::2], row[1::2]))


def largest_exponent(shares: DataFrame, holds, low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent in [low, high] with ``holds(e, sum of p^e, sum of p^e * ln(p))``, true up to there and false beyond; ``low`` where it never holds.

    Bisection with many arms: each pass over the sources leaves one of ``TRIED`` intervals.
    """
    for _ in range(PASSES):
        tried = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
        held = [holds(e, *sums) for e, sums in zip(tried, power_sums(shares, tried))]
        last = max((i for i, ok in enumerate(held) if ok), default=-1)
        if last in (-1, TRIED):
            return tried[max(last, 0)]
        low, high = tried[last], tried[last + 1]
    return low


def entropy_of(e: float, total: float, weighted: float) -> float:
    """Entropy of the weights p^e / total."""
    return math.log(total) - e * weighted / total


def solve_exponent(shares: DataFrame, entropy_share: float | None, max_repeats: float | None, budget_share: float | None) -> tuple[float, float, float]:
    """(exponent in [0, 1], sum of p^exponent, share of the largest entropy reached) for source token shares ``share``.

    The exponent falls from 1 (weights as the shares) until the weights have
    ``entropy_share`` of the largest entropy (log of the number of sources), but never
    below the exponent at which a document is read ``max_repeats`` times. The rarest
    source repeats most: (largest share / its share) ^ (1 - e) times where the budget
    just reads every source once, ``budget_share`` * p^(e - 1) / sum of p^e times where the
    budget is so many times all tokens. A budget that passes the limit at every exponent
    raises a ValueError.
    """
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("share"), F.max("share")).first()
    wanted = (entropy_share or 0.0) * math.log(n)
    # both hold up to some exponent: the entropy is met, and the limit is passed
    exponent = largest_exponent(shares, lambda e, s, w: entropy_of(e, s, w) >= wanted) if n > 1 else 1.0
    if max_repeats and budget_share is None:
        exponent = max(exponent, 0.0 if most / least <= max_repeats else 1 - math.log(max_repeats) / math.log(most / least))
    elif max_repeats:
        passed = lambda e, s: budget_share * least ** (e - 1) / s > max_repeats * (1 + 1e-12)
        if passed(1.0, 1.0):
            raise ValueError(f"a budget of {budget_share:g} times all tokens repeats documents more than {max_repeats:g} times")
        exponent = max(exponent, largest_exponent(shares, lambda e, s, w: passed(e, s)))
    ((total, weighted),) = power_sums(shares, [exponent])
    return exponent, total, entropy_of(exponent, total, weighted) / math.log(n) if n > 1 else 1.0


def order_key(doc_id: Column, block: Column, seed: int) -> Column:
    """A document's place in the permutation of a block: 16 hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), doc_id.cast("long").cast("string"))), 1, 16)


def with_plan(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with the plan (a row for each ``key``, ``copies`` rows each)."""
    n, total = plan.agg(F.count(F.lit(1)), F.sum("copies")).first()
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), key)
    return join_small_values(rows, plan, key, "copies", max(1, total))


def plan_mixture(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each source: source, key, copies, tokens, exponent, entropy, weight, epochs, full_blocks, cut.

    ``budget`` is the number of tokens to read, of which a source gets its weight's
    share; without one it is the least that reads every source whole. A source is read
    ``epochs`` times: ``full_blocks`` whole permutations of its documents, and of one
    more permutation the documents whose ``order_key`` is up to ``cut``. The cut is where
    the tokens of the documents before reach the rest of the source's budget. It is found
    from sums of 4096 key ranges a source, and in the one range that holds it row by
    row, so no source is gathered in one task. ``entropy`` is the share of the largest
    entropy that the weights have: below ``entropy_share`` where ``max_repeats`` forbids
    more. Any number of sources is planned by aggregates; none reach the driver.
    """
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"), tokens.alias("tokens")), "source-tokens")
    sources = written(rows.groupBy("key").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if total:
        share = F.col("tokens") / F.lit(float(total))
        shares = sources.filter("tokens > 0").select(share.alias("share"))
        most = shares.agg(F.max("share")).first()[0]
        exponent, norm, entropy = solve_exponent(shares, entropy_share, max_repeats, budget / total if budget is not None else None)
        weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / norm).otherwise(0.0)
        times = F.greatest(F.lit(1.0), F.pow(F.lit(most) / share, F.lit(1 - exponent))) if budget is None else F.lit(float(budget)) * weight / F.col("tokens")
        epochs = F.when(F.col("tokens") > 0, F.round(times, 9)).otherwise(1.0)
    else:
        exponent, entropy, weight, epochs = 1.0, 1.0, F.lit(0.0), F.lit(1.0)
    plan = sources.withColumns({"exponent": F.lit(exponent), "entropy": F.lit(entropy), "weight": weight, "epochs": epochs})
    plan = plan.withColumn("full_blocks", F.floor("epochs")).withColumn("rest", F.floor((F.col("epochs") - F.col("full_blocks")) * F.col("tokens")))
    plan = written(plan, "mixture-plan")
    keyed = with_plan(rows, plan.filter("rest > 0").select("key", "copies", "full_blocks", "rest"), "key").filter("rest > 0")
    keyed = keyed.select("key", "tokens", "rest", order_key(F.col("doc_id"), F.col("full_blocks"), seed).alias("place")).withColumn("range", F.substring("place", 1, 3))
    sums = keyed.groupBy("key", "range").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    edge = before.filter("before < rest and before + sum >= rest").select("key", "range", "before")
    inside = keyed.join(edge, ["key", "range"])
    by_place = inside.groupBy("key", "place", "before", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    reach = by_place.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    # the last place that is in: its documents start before the budget ends
    cuts = reach.filter("at < rest").groupBy("key").agg(F.max("place").alias("cut"))
    return plan.drop("rest").join(cuts, "key", "left")


def mix_sources(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with a row for each time the mixture reads a document.

    All columns stay, and ``mix_block`` (the permutation, from 0), ``mix_key`` (its
    place in that permutation) and ``mix_weight`` (its source's weight) are added;
    where ``docs`` has columns of these names they are replaced. Options are those of
    ``plan_mixture``. Without a budget nothing is dropped and small sources repeat; with a
    smaller one, sources are read in part. The plan, a row for each source, is broadcast
    up to ``BROADCAST_SOURCES`` sources and texts aren't shuffled; beyond, rows meet the
    plan by source, frequent sources by broadcast.

    A null source is a source of its own. Sources without tokens are read once.
    Null and empty texts have no tokens and go where their key falls. Rows that repeat
    an id share its key. An empty table stays empty.
    """
    docs = docs.drop("mix_block", "mix_key", "mix_weight")
    plan = written(plan_mixture(docs, seed=seed, id_col=id_col, source_col=source_col, **options).select("key", "copies", F.struct("weight", "full_blocks", "cut").alias("plan")), "mixture")
    rows = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col(source_col)).alias("key"))
    joined = with_plan(rows, plan, "key").select("row", "plan")
    place = lambda block: order_key(F.col("row")[id_col], block, seed)
    more = F.coalesce(place(F.col("plan.full_blocks")) <= F.col("plan.cut"), F.lit(False)).cast("long")
    blocks = F.col("plan.full_blocks") + more
    drawn = joined.filter(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return drawn.select("row.*", F.col("block").cast("int").alias("mix_block"), place(F.col("block")).alias("mix_key"), F.col("plan.weight").alias("mix_weight"))
