"""Operator 12: mixing sources to target weights by entropy balancing.

Documents get rates ``r`` (expected copies) that stay as close to 1 as the targets allow: they minimise the sum of
``r log r - r + 1`` with ``0 <= r <= cap`` under one token constraint for each source, that its documents' words times
rates make its target. The convex dual has one multiplier for each source and the solution is an exponential tilt,
``r = min(cap, exp(multiplier * size))``. Newton steps for all sources at once take their sums from Spark, inside brackets that
bisection falls back to. Rates are then rounded into whole copies so that the words of a source add up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.llm.common import SPACE, materialize, remove, table, text_or_empty

#: A source is told by its name; null is a source of its own, after all names.
SOURCE = ["none", "name"]
#: Rates are summed as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1_000_000_000
#: A source is balanced when its words are this near its target: one in a million, or half a word.
NEAR, HALF = 1e-6, 0.5
#: Bisection alone would need fewer steps.
MAX_STEPS = 200


def sizes(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``key, none, name, size, salt``: each document's source, words and a number that orders equals at random."""
    size = F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE}]+")).cast("long")
    return documents.select(F.col(key).alias("key"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"), size.alias("size"), F.xxhash64(F.col(key)).alias("salt"))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows with their ``place`` from 1 in this order over the whole table: sorted ranges, with the counts of the ranges before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    kept = kept.withColumns({"range": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND((1 << 33) - 1)})
    # One row for each range.
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = kept.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return kept.join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("inside") + 1).drop("at", "range", "inside", "before")


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources`` (``none, name, source_size``) with ``target``: all words dealt by repeating weights, each up to ``cap`` times its size.

    What is above the bound is dealt again by weight among the sources that aren't at theirs, until none is above.
    """
    ranked = materialize(numbered(sources, SOURCE, "mixing-order"), "mixing-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).drop("place")
    level, full = None, None
    while True:
        # With every step the level rises, and sources only join those that are full.
        is_full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * cap
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(is_full, F.col("source_size"))).alias("full"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight"), F.count_if(is_full).alias("n")).first()
        if row["n"] == full or not row["weight"]:
            break
        full = row["n"]
        level = ((row["all"] or 0) - cap * (row["full"] or 0)) / row["weight"]
    if level is None:
        return ranked.select(*SOURCE, "source_size", F.lit(0.0).alias("target"))
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double"))
    return ranked.select(*SOURCE, "source_size", target.alias("target"))


def tilts(classes: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """``goals`` with ``scale`` and ``tilt``: a document of ``size`` words has the rate ``min(cap, exp(tilt * size / scale))``.

    ``classes`` counts the documents of each source and size. A source whose target is at its bound, or that has no words,
    has a null tilt. The root lies between 0 and ``scale * log(target / source_size)``, as no text with words has fewer than one.
    """
    squares = classes.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).alias("squares"))
    scale = F.greatest(F.round(F.col("squares") / F.col("source_size"), 3), F.lit(1.0))
    goals = goals.join(squares, SOURCE).withColumn("open", (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap))
    end = F.col("scale") * F.log(F.col("target") / F.col("source_size"))
    zero = F.lit(0.0)
    state = goals.withColumn("scale", F.when(F.col("open"), scale)).drop("squares")
    state = state.withColumns({"low": F.when(F.col("open"), F.least(end, zero)), "high": F.when(F.col("open"), F.greatest(end, zero)), "tilt": F.when(F.col("open"), zero)})
    state = materialize(state, "mixing-state")
    for _ in range(MAX_STEPS):
        if state.where("open").isEmpty():
            return state.drop("open", "low", "high")
        stepped = materialize(_newton_step(classes, state, cap), "mixing-state")
        remove(state)
        state = stepped
    raise RuntimeError("the multipliers of some sources were not found")


def _newton_step(classes: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    x = F.col("size") / F.col("scale")
    rate = F.least(F.exp(F.col("tilt") * x), F.lit(float(cap)))
    whole = lambda c: F.round(c * UNIT).cast("decimal(19,0)") * (F.col("n") * F.col("size")).cast("decimal(19,0)")
    sums = classes.join(state.where("open").select(*SOURCE, "scale", "tilt"), SOURCE).groupBy(*SOURCE).agg(
        F.sum(whole(rate)).alias("words"), F.sum(whole(F.when(rate < cap, rate * x).otherwise(0.0))).alias("slope")
    )
    of = lambda c: F.col(c).cast("double") / UNIT
    after = state.join(sums, SOURCE, "left").withColumn("gap", of("words") - F.col("target"))
    done = F.abs("gap") <= F.greatest(F.col("target") * NEAR, F.lit(HALF))
    low, high = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))
    after = after.withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high"))})
    step = F.col("tilt") - F.col("gap") / F.nullif(of("slope"), F.lit(0.0))
    inside = (step > F.col("low")) & (step < F.col("high"))
    after = after.withColumn("next", F.when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("low") + F.col("high")) / 2))
    # A bracket without a number inside can't be narrowed further.
    still = F.col("open") & ~done & (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
    return after.withColumn("still", still).select(*SOURCE, "source_size", "target", F.col("still").alias("open"), "scale", "low", "high", F.when(F.col("still"), F.col("next")).otherwise(F.col("tilt")).alias("tilt"))


def class_copies(classes: DataFrame, tilted: DataFrame, cap: int) -> DataFrame:
    """``none, name, size, n, source_size, target, rate, copies``: copies that all documents of a source and size get together.

    From the longest to the shortest, what one size misses of its words is carried to the next; the shortest texts settle it. A
    group has one row for each size of a source.
    """
    rate = F.when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("scale")), F.lit(float(cap))))
    rated = classes.join(tilted, SOURCE).select(*SOURCE, "size", "n", "source_size", "target", rate.alias("rate"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ascending=False)
        carried, copies = 0.0, []
        for size, n, r in zip(frame["size"].tolist(), frame["n"].tolist(), frame["rate"].tolist(), strict=True):
            if not size:
                copies.append(n)
                continue
            wanted = n * r * size + carried
            copies.append(min(max(round(wanted / size), 0), cap * n))
            carried = wanted - copies[-1] * size
        return frame.assign(copies=copies)

    return rated.groupBy(*SOURCE).applyInPandas(settle, "none boolean, name string, size long, n long, source_size long, target double, rate double, copies long")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """How many copies of each document a mix takes whose words come from the sources by weight.

    A text's size is its number of words. Sources in the order of their code points, null last, have the weights in turn and
    share as many words as there are; a target stops at ``cap`` times its source's size, and what is over goes to the others
    by weight. Columns: ``key, size, source_size, target, taken, copies, rate``; ``taken`` is ``copies * size``, at most ``cap`` times the size.

    Null texts have no words; documents without words are taken once; documents without a key and repeated rows count each; an
    empty table gives none; other columns are not looked at. Of documents of one source and size those with the smallest
    hash of the key get the copy that not all can have, so runs agree, whatever the partitions.
    """
    rows = materialize(sizes(documents, text, source, key).withColumn("row", F.monotonically_increasing_id()), "mixing-sizes")
    classes = materialize(rows.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")), "mixing-classes")
    goals = targets(classes.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    settled = class_copies(classes, tilts(classes, goals, cap), cap)
    placed = numbered(rows, [*SOURCE, "size", "salt", "key", "row"], "mixing-places")
    first = placed.groupBy(*SOURCE, "size").agg(F.min("place").alias("first"))
    dealt = placed.join(settled.join(first, [*SOURCE, "size"]), [*SOURCE, "size"])
    extra = (F.col("place") - F.col("first") < F.pmod("copies", "n")).cast("long")
    dealt = dealt.withColumn("each", F.expr("copies div n") + extra)
    return dealt.select("key", "size", "source_size", "target", (F.col("each") * F.col("size")).alias("taken"), F.col("each").alias("copies"), "rate")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
