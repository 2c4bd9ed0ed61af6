"""Mixing sources to target weights by entropy balancing.

Sources in code-point order, null last, weigh ``weights`` in turn and share the words of all documents;
a target stops at ``most`` times its source's words and the excess is shared again by weight, which
fills the sources to one common level per weight (``targets``).

Document i of a source gets the rate r_i in [0, most] that is nearest to 1 in entropy among the rates
that meet the token constraint sum(r_i * size_i) = target. The dual of that problem is convex with one
multiplier per source, and its solution tilts exponentially by size: r_i = min(most, exp(u * size_i / mean)).
Equal sizes in a source have equal rates, so the dual runs over the histogram of (source, size). A
Newton iteration is one aggregate over it: words at the present multipliers and their slope. Steps are
taken on the logarithm of the words, which is nearly straight, and bisect where they would leave the
bracket found so far.

Rates become copies by rounding running sums of the fractions of each source, longest documents first:
what has been rounded off is never more than one document, so the words miss the target by the longest
document at most; of sixteen offsets at which rounding may begin each source takes the best. The rest is then made up with the shortest documents that still fit. Which of
the documents of one size take the extra copy goes by a hash of their ids, so reruns agree.

Null text has no words; such documents, and sources without any word, get no copies. Null ids are
documents like others; of rows that repeat source, size and id any may take the extra copy. Empty
tables give empty results. Columns of ``docs`` other than doc_id, text and source are not read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.ranges import global_index, rank_in_group, running
from .common import columns_of, small, store, text_of

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, CLOSE = 200, 1e-10
UNIT = 1_000_000        # fractions of copies are whole numbers of this unit, so sums don't depend on their order
OFFSETS = 16
PLAN_ROWS = 200_000     # sources or classes up to this number are broadcast, more are joined by shuffle


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) with ``target``: min(most * source_size, level * weight) at the level that uses all words."""
    turn = global_index(sources, [F.col("source").isNull(), F.col("source")], "__llm_at")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__llm_at") % len(weights) + 1).cast("int"))
    rows = turn.withColumns({"w": weigh, "cap": F.col("source_size") * F.lit(float(most))}).withColumn("fill", F.col("cap") / F.col("w"))
    # in the order in which sources fill up: the level if exactly those before a source were full; the true one is the highest
    below = running(rows, [], [F.col("fill"), F.col("__llm_at")], {"full": F.col("cap"), "heavy": F.col("w")})
    total = rows.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    level = (F.lit(total["words"]) - F.col("full") + F.col("cap")) / (F.lit(total["w"]) - F.col("heavy") + F.col("w"))
    top = below.agg(F.max(level).alias("level")).first()["level"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(top).cast("double") * F.col("w")).alias("target"))


def rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.col("u") * F.col("size") / F.col("mean")))


def tilt(classes: DataFrame, goals: DataFrame, most: float = 3.0) -> DataFrame:
    """Multiplier ``u`` of each source: Newton on the dual of the entropy problem, all sources at once.

    ``classes`` (key, size, n), ``goals`` (key, target, mean). Sources whose target is all they can give,
    or nothing, are settled at once.
    """
    inf = F.lit(float("inf"))
    u0 = F.when(F.col("target") <= 0, -inf).otherwise(F.when(F.col("target") >= F.col("full"), inf).otherwise(F.lit(0.0)))
    state = store(goals.select("key", "target", "mean", u0.alias("u"), (-inf).alias("lo"), inf.alias("hi"), F.abs(u0).isin(float("inf")).alias("done")))
    few = state.count() <= PLAN_ROWS
    for _ in range(ROUNDS):
        open_, r = state.filter(~F.col("done")), rate(most)
        sums = classes.join(F.broadcast(open_) if few else open_, "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("words"),
            F.sum(F.when(r < most, F.col("n") * F.col("size") * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        miss = F.when(F.col("words") > 0, F.log(F.col("words") / F.col("target"))).otherwise(-inf)
        lo = F.when(miss < 0, F.greatest("lo", "u")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.least("hi", "u")).otherwise(F.col("hi"))
        step = F.col("u") - miss * F.col("words") / F.col("slope")
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > F.col("lo1")) & (step < F.col("hi1")) & ~F.isnan(step)
        # outside the bracket, or where all rates are at their most: halve the bracket, or widen it twofold
        halved = (F.when(F.col("lo1") == -inf, F.least(F.col("hi1") * 2, F.col("hi1") - 1))
                  .otherwise(F.when(F.col("hi1") == inf, F.greatest(F.col("lo1") * 2, F.col("lo1") + 1)).otherwise((F.col("lo1") + F.col("hi1")) / 2)))
        moved = state.join(sums, "key", "left").withColumns({"lo1": lo, "hi1": hi})
        settled = F.col("done") | (F.abs(miss) < CLOSE) | (F.col("hi1") - F.col("lo1") < 1e-14 * F.greatest(F.abs("lo1"), F.abs("hi1")))
        state = store(moved.select("key", "target", "mean", F.when(settled, F.col("u")).otherwise(F.when(inside, step).otherwise(halved)).alias("u"),
                                   F.when(settled, F.col("lo")).otherwise(F.col("lo1")).alias("lo"),
                                   F.when(settled, F.col("hi")).otherwise(F.col("hi1")).alias("hi"), settled.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            return state.select("key", "u")
    raise ValueError(f"the multipliers of some sources did not settle in {ROUNDS} rounds")


def copies_by_class(classes: DataFrame, most: float = 3.0) -> DataFrame:
    """``classes`` (key, size, n, target, mean, u) with ``whole``, the copies of every document of the class, and
    ``extra``, the number of its documents that take one more."""
    r = F.when(F.col("u").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(rate(most))
    rows = classes.withColumn("r", r).withColumn("whole", F.floor("r")).withColumn("part", F.col("n") * F.round((F.col("r") - F.col("whole")) * UNIT).cast("bigint"))
    summed = store(running(rows, ["key"], [F.desc("size")], {"upto": F.col("part")}))

    def extra(offset: Column | int) -> Column:
        upto = lambda c: F.floor((c + offset) / UNIT)
        return F.greatest(F.lit(0), F.least(F.col("n"), upto(F.col("upto")) - upto(F.col("upto") - F.col("part")))).cast("bigint")

    # rounding may begin at any offset; each source takes the one that leaves its words nearest to the target
    offsets = [(2 * k + 1) * UNIT // (2 * OFFSETS) for k in range(OFFSETS)]
    missed = [(F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("whole") + extra(o)))).alias(f"m{o}") for o in offsets]
    best = F.array_min(F.array(*[F.struct(F.abs(f"m{o}").alias("by"), F.abs(F.lit(o) - UNIT // 2).alias("off"), F.lit(o).alias("offset"),
                                          F.col(f"m{o}").alias("short")) for o in offsets]))
    short = store(summed.groupBy("key").agg(*missed).select("key", best.alias("b")).select("key", "b.offset", "b.short"))
    first = summed.join(small(short, PLAN_ROWS), "key").withColumn("extra", extra(F.col("offset")))
    # what is short (or over) is made up from the shortest documents up, as far as whole documents fit
    add = F.when(F.col("whole") + 1 <= most, F.col("n") - F.col("extra")).otherwise(F.lit(0))
    spare = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.when(F.col("short") >= 0, add).otherwise(F.col("extra"))).cast("bigint")
    open_ = first.withColumn("spare", spare)
    laid = running(open_, ["key"], [F.col("size")], {"reach": F.col("spare") * F.col("size")})
    room = F.abs("short") - (F.col("reach") - F.col("spare") * F.col("size"))
    more = F.when(F.col("spare") > 0, F.greatest(F.lit(0), F.least(F.col("spare"), F.floor(room / F.col("size") + 0.5)))).otherwise(F.lit(0))
    return laid.select("key", "size", "whole", (F.col("extra") + F.when(F.col("short") >= 0, more).otherwise(-more)).cast("bigint").alias("extra"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of ``docs``."""
    columns_of(docs, ["doc_id", "text", "source"])
    return mix_sizes(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size")), weights, most)


def mix_sizes(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """As ``mix``, for rows (doc_id, source, size, ...) whose words are counted; other columns stay."""
    # a source is named by a struct, so that null is a name like others and joins with itself
    rows = store(sized.withColumn("key", F.to_json(F.struct("source"))))
    classes = store(rows.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    per = store(classes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                           F.sum("n").alias("docs")))
    aims = targets(per.select("source", "source_size"), weights, most)
    goals = store(per.drop("source_size").join(aims.withColumn("key", F.to_json(F.struct("source"))).drop("source"), "key").withColumns({
        "mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)), "full": F.col("source_size") * F.lit(float(most))}))
    solved = tilt(classes.filter("size > 0"), goals, most)
    plan = small(goals.drop("source", "docs", "full").join(solved, "key"), PLAN_ROWS)
    tilted = classes.drop("source").join(plan, "key")
    held = store(copies_by_class(tilted, most).join(plan, "key"))
    # which documents of a class take the extra copy
    ranked = rank_in_group(rows, ["key", "size"], [F.xxhash64("doc_id"), F.col("doc_id")], "__llm_rank")
    got = F.col("whole") + (F.col("__llm_rank") < F.col("extra")).cast("bigint")
    return (ranked.join(small(held.withColumn("rate", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(rate(most))).drop("mean", "u"), PLAN_ROWS), ["key", "size"])
            .withColumn("copies", got).withColumn("taken", F.col("copies") * F.col("size"))
            .select(*sized.columns, "source_size", "target", "rate", "copies", "taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them. Rows are stored once under a number of
    their own; sizes and numbers alone are planned, and the copies are joined back."""
    columns_of(docs, ["doc_id", "text", "source"])
    held = store(docs.withColumn("__llm_row", F.monotonically_increasing_id()))
    plan = mix_sizes(held.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"), "__llm_row"), weights, most)
    often = plan.filter("copies > 0").select("__llm_row", F.col("copies").alias("__llm_copies"))
    return held.join(often.hint("shuffle_hash"), "__llm_row").select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__llm_copies"))).alias("__llm_copy")).drop("__llm_copy")
