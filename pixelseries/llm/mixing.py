"""Mixing sources to target weights by entropy balancing.

A document of prior rate q and size s gets the rate r = min(cap, q * exp(lambda * s / scale)), lambda being its source's
and scale the source's mean size: of all rates that meet the sources' token targets these are the nearest to the prior
in relative entropy over documents. So a source that must grow takes more of its long documents, one that must shrink more
of its short ones. The dual is convex and falls apart by source; bracketed Newton steps solve it, each one summing value
and slope over all documents (of equal source, prior and size together) with exact decimal sums, so that reruns agree.
A source whose target is all that the cap allows has its multiplier at infinity: every document has the rate cap.

Rates are rounded into copies by systematic sampling: a document gets as many copies as whole numbers lie between the
running sums of rates before and behind it, in order of size. The words that a source still misses or has too many
are then mended by a few single documents that gain or lose a copy.

Documents with a null source are one source of their own, last in order. Null and empty texts have size 0 and take nothing.
Very long texts count whole. Null or repeated doc_ids and repeated rows are documents of their own; ties in size are broken
by doc_id and text. An empty table gives an empty result. Extra columns are ignored, whatever their names. Sources are
numbered in one task, so there may be millions of them, not billions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelseries.llm.common import keyed, running, scratch, small, stored, words

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2
UNIT = 1_000_000  # rates are rounded to so many parts, so that adding them up is exact
MEND_ROUNDS = 6
EXACT = "decimal(32,12)"  # of sums whose order must not matter
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """(grp, source, source_size, target) from (grp, source, source_size). Shares of `total` times all words by the
    weights, repeating in the sources' order; no target is above `cap` times its source's size, and what is cut goes to
    the others by weight. A source is cut if its limit a weight is below the level that is left to it and those after."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(place) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size"))
    # limits a weight compared without fractions: weights are small whole numbers
    scale = 1
    for w in weights:
        scale *= w
    order = Window.orderBy((F.col("limit") * F.lit(scale) / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(total)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(onward))
    rows = rows.withColumn("cut", F.col("limit") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("cut"), F.struct((F.col("limit") * F.lit(scale) / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)
    target = F.when(F.col("cut"), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), level["level"] * F.col("weight")))
    return rows.select("grp", "source", "source_size", target.alias("target"))


def tilted(cap: float) -> Column:
    """A document's rate from its prior and size and its source's lam (null: all at the cap) and scale."""
    grown = F.col("prior") * F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0)))
    return F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), grown))


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-12, most: int = 100) -> DataFrame:
    """(grp, lam, scale): the dual's solution. cells: (grp, prior, size, n), the documents with equal source, prior and
    size, sizes above 0; targets: (grp, target). Newton steps are taken on the logarithm of the words, which is nearly
    straight; a step that leaves the bracket known so far or does not halve what is missing becomes a bisection."""
    mass = F.col("n") * F.col("size")
    most_words = F.sum(mass).cast("double")
    sums = cells.groupBy("grp").agg(most_words.alias("mass"), (most_words / F.sum("n")).alias("scale"), F.min("prior").alias("least"), F.max("prior").alias("greatest"))
    start = targets.select("grp", "target").join(sums, "grp").where("mass > 0 and target > 0")
    full = F.col("target") >= F.lit(float(cap)) * F.col("mass")
    # at these ends every document is at the cap, or all together have less than the target
    low = F.col("scale") * F.least(F.lit(0.0), F.ln(F.col("target") / (F.col("mass") * F.col("greatest")))) - 1
    high = F.col("scale") * F.greatest(F.lit(0.0), F.ln(F.lit(float(cap)) / F.col("least"))) + 1
    start = start.select("grp", "target", "scale", F.when(~full, F.lit(0.0)).alias("lam"), low.alias("low"), high.alias("high"), F.lit(float("inf")).alias("off"))
    state = stored(start, "dual")
    for _ in range(most):
        rate = tilted(cap)
        slope = F.when(rate < cap, mass * rate * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = cells.join(state, "grp").where("lam is not null").groupBy("grp").agg(
            F.sum((mass * rate).cast(EXACT)).cast("double").alias("has"), F.sum(slope.cast(EXACT)).cast("double").alias("slope")
        )
        now = state.join(sums, "grp", "left").withColumn("was", F.col("off"))
        off = F.ln(F.col("has") / F.col("target"))
        now = now.withColumn("off", F.when(F.abs(off) > tolerance, off).otherwise(0.0))  # at the cap: null is 0
        now = now.withColumns({"low": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("high"))})
        step = F.col("lam") - F.when(F.col("slope") > 0, F.col("off") * F.col("has") / F.col("slope"))
        good = (step > F.col("low")) & (step < F.col("high")) & (F.abs("off") <= F.abs("was") / 2)
        nxt = F.when(F.col("off") == 0, F.col("lam")).when(good, step).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(now.select("grp", "target", "scale", nxt.alias("lam"), "low", "high", "off"), "dual")
        if state.where("off <> 0 and high - low > 1e-14 * greatest(1, abs(lam))").isEmpty():
            break
    return state.select("grp", "lam", "scale")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, cap: int = CAP, prior: Column | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, the carried columns, size, source, source_size, target, rate, copies, taken (copies times size). prior: a
    document's rate before balancing, above 0; 1 by default."""
    source = F.col("source").cast("string")
    rows = docs.select(
        "doc_id",
        *carry,
        F.size(words(F.col("text"))).cast("long").alias("size"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("grp"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"),
        (F.lit(1.0) if prior is None else prior.cast("double")).alias("prior"),
    )
    rows = stored(rows, "sizes")
    totals = rows.groupBy("grp").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, total, cap), "targets")
    cells = stored(rows.where("size > 0").groupBy("grp", "prior", "size").agg(F.count("*").alias("n")), "cells")
    plan = stored(targets.join(balance(cells, targets, cap), "grp", "left").drop("source"), "plan")
    # broadcast behind a check of its size: dealt by source, a source's rows would stay in one task up to their numbering
    few = targets.count() <= BROADCAST_SOURCES

    rated = rows.join(F.broadcast(plan) if few else plan, "grp")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, tilted(cap)).otherwise(0.0)).drop("lam", "scale")
    units = F.bround(F.col("rate") * UNIT).cast("long")
    rated = rated.withColumn("whole", F.floor(units / UNIT)).withColumn("part", units - F.col("whole") * UNIT)
    # cells of a size class: as many as keep both their number and the rows of one in bounds
    chunks = max(1, math.isqrt(rows.count()) // 8)
    order = [-F.length(F.bin("size")), F.pmod(F.xxhash64("doc_id", "tie", "size"), F.lit(chunks))]  # larger documents first
    rated = running(rated, "grp", order, [F.desc("size"), F.col("doc_id"), F.col("tie")], {"nth": F.lit(1), "before": F.col("part")})
    copies = F.col("whole") + F.floor((F.col("before") + F.col("part") + UNIT // 2) / UNIT) - F.floor((F.col("before") + UNIT // 2) / UNIT)
    rated = stored(rated.withColumn("copies", copies.cast("long")), "copies")

    gap = stored(rated.groupBy("grp").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")), "gap")
    flips: DataFrame | None = None
    for _ in range(MEND_ROUNDS):
        now = rated if flips is None else _flipped(rated, flips)
        now = now.join(gap, "grp")
        moves = F.filter(F.array(F.when(F.col("copies") < cap, F.lit(1)), F.when(F.col("copies") > 0, F.lit(-1))), lambda m: m.isNotNull())
        moves = now.where("size > 0").select("grp", "nth", "gap", "size", F.explode(moves).alias("move"))
        left = F.abs(F.col("gap") - F.col("move") * F.col("size"))
        best = moves.where(left < F.abs("gap")).groupBy("grp").agg(F.min(F.struct(left.alias("left"), "nth", "move", "size")).alias("b"))
        best = stored(best.select("grp", F.col("b.nth").alias("nth"), F.col("b.move").alias("move"), (F.col("b.move") * F.col("b.size")).alias("gain")), "flips")
        flips = best.select("grp", "nth", "move") if flips is None else flips.unionByName(best.select("grp", "nth", "move"))
        gap = stored(gap.join(best, "grp", "left").select("grp", (F.col("gap") - F.coalesce("gain", F.lit(0))).alias("gap")), "gap")
    out = _flipped(rated, flips)
    return out.select("doc_id", *carry, "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _flipped(rated: DataFrame, flips: DataFrame) -> DataFrame:
    """flips holds a few rows of each source."""
    moved = flips.groupBy("grp", "nth").agg(F.sum("move").alias("move"))
    return rated.join(moved, ["grp", "nth"], "left").withColumn("copies", (F.col("copies") + F.coalesce("move", F.lit(0))).cast("long")).drop("move")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies."""
    held = keyed(docs)
    with scratch(docs.sparkSession) as tables:
        shares = mix(held.select("row", "doc.doc_id", "doc.text", "doc.source"), carry=("row",), **options).where("copies > 0")
        shares = stored(shares.select("row", F.col("copies").cast("int").alias("copies")), "shares")
        tables.keep(shares)
    return held.join(small(shares), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
