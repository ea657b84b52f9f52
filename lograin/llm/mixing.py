"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates stay as near to 1 as relative entropy allows while each source meets
its token target. The optimum is an exponential tilt, ``rate = min(cap, exp(lambda *
size / mean size))`` with one dual variable per source; safeguarded Newton steps on the
convex dual find it, each step being one aggregation over (source, size) counts. Sums
of rates are taken in integers (units of 2^-20), so reruns agree bit for bit.

Rates become copies by systematic rounding in the order of size: fractions are summed
along the order and a document rounds up where the sum passes an integer, which leaves
each source off its target by about one document. Then the one document of each source
whose size comes nearest to what is missing (or too much) gets one copy more (or less).

Hot sources: counts are partial aggregates, running sums go over size classes first,
and equal sizes are dealt to buckets before they are ranked.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; documents without words are never taken; rows repeating an id are rated as rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograin.llm.order import positions
from lograin.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 20
TOLERANCE = 1e-6
MAX_STEPS = 80
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, total, docs, smallest, target): the shared size by weight, no source above ``cap`` times its own.

    ``weights`` repeat over the sources in order. What capped sources leave is
    shared again among the others until none is above.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("total"), F.count("*").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest")
    )
    ranked = positions(totals, [F.col("source").asc_nulls_last()])
    turn = F.array(*map(F.lit, weights))[F.pmod("position", F.lit(len(weights))).cast("int")]
    sources = materialize(ranked.select("source", "total", "docs", "smallest", turn.cast("double").alias("weight")))
    goal = share * (sources.agg(F.sum("total")).first()[0] or 0)
    level, limit = 0.0, F.col("total") * cap
    while True:
        full = F.col("weight") * level >= limit
        spent, weight = sources.agg(
            F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        following = (goal - spent) / weight if weight else level
        if following <= level:
            break
        level = following
    return sources.select(
        "source", "total", "docs", "smallest", F.least(F.col("weight") * level, limit).alias("target")
    )


def _rate(cap: float) -> Column:
    """Tilted rate of a row with ``size``, ``mean`` and ``lam``."""
    return F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))


def _units(rate: Column) -> Column:
    return F.floor(rate * UNIT)


def tilts(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Solve the dual: one ``lam`` per source.

    ``counts`` has (source, size, n). The bracket holds the root from the start, as
    the smallest size bounds every rate; a Newton step that leaves it is replaced by
    its middle.
    """
    mean = F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9))
    edge = F.coalesce(mean / F.col("smallest"), F.lit(0.0))
    lowest = F.when(F.col("target") < F.col("total"), edge * F.log(F.col("target") / F.col("total"))).otherwise(0.0)
    highest = F.when(F.col("target") > F.col("total"), edge * F.log(F.lit(float(cap)))).otherwise(0.0)
    at_cap = F.col("target") >= F.col("total") * cap
    state = materialize(
        targets.select(
            "source", "target", mean.alias("mean"), lowest.alias("lo"), (highest * 1.001).alias("hi"),
            F.when(at_cap, highest * 1.001).otherwise(0.0).alias("lam"),
            (at_cap | F.col("smallest").isNull()).alias("done"),
        )
    )
    names = state.columns
    for _ in range(MAX_STEPS):
        if not state.filter("not done").limit(1).count():
            break
        rate, words = _rate(cap), (F.col("n") * F.col("size")).cast("decimal(20,0)")
        slope = F.when(rate < cap, F.floor(rate * F.col("size") / F.col("mean") * UNIT)).otherwise(0)
        tilted = counts.withColumnRenamed("source", "of").join(state, F.col("of").eqNullSafe(F.col("source")))
        sums = tilted.groupBy(*names).agg(
            F.sum(words * _units(rate).cast("decimal(12,0)")).cast("double").alias("taken"),
            F.sum(words * slope.cast("decimal(18,0)")).cast("double").alias("slope"),
        )
        gap = F.col("taken") / UNIT - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") - gap * UNIT / F.col("slope")
        stepped = sums.withColumns({"gap": gap, "low": lo, "high": hi, "newton": F.when(F.col("slope") > 0, newton)})
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        met = F.col("done") | (F.abs("gap") <= F.col("target") * TOLERANCE) | (F.col("high") - F.col("low") < 1e-12)
        following = F.when(met, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(
            stepped.select(
                "source", "target", "mean", F.col("low").alias("lo"), F.col("high").alias("hi"),
                following.alias("lam"), met.alias("done"),
            )
        )
    return state.select("source", "target", "mean", "lam")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Copies of every document in the mix.

    Columns: doc_id, size, source_size, target, taken, source, copies.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select("doc_id", "source", words.alias("size")))
    counts = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = materialize(source_targets(sizes, weights, share, cap))
    solved = tilts(counts, targets, cap).select(F.col("source").alias("of"), "mean", "lam")
    rated = counts.join(solved, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("size").alias("of_size"), "n", _units(_rate(cap)).alias("units")
    )
    bucket = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BUCKET_ROWS)).alias("bucket")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
    dealt = materialize(sizes.join(rated, same).select("doc_id", "source", "size", "units", bucket))

    # Running sums of the fractions: size classes of a source, then cells of a class.
    scale = F.floor(8 * F.log2(F.col("size") + 1)).alias("scale")
    cells = dealt.groupBy("source", "size", "bucket", "units").agg(F.count("*").alias("n")).select(
        "*", scale, (F.pmod("units", F.lit(UNIT)) * F.col("n")).alias("part")
    )
    cells = materialize(cells)
    classes = cells.groupBy("source", "scale").agg(F.sum("part").alias("class_part"))
    up_to = Window.partitionBy("source").orderBy("scale").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(
        F.col("source").alias("of"), F.col("scale").alias("of_scale"),
        F.coalesce(F.sum("class_part").over(up_to), F.lit(0)).alias("class_start"),
    )
    inside = Window.partitionBy("source", "scale").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    in_class = F.col("source").eqNullSafe(F.col("of")) & (F.col("scale") == F.col("of_scale"))
    end = F.col("class_start") + F.col("run") + UNIT // 2
    raised = F.floor(end / UNIT) - F.floor((end - F.col("part")) / UNIT)
    raised = cells.withColumn("run", F.sum("part").over(inside)).join(classes, in_class).select(
        F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("bucket").alias("of_bucket"), raised.alias("raised")
    )
    in_cell = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit("turn")), "doc_id")
    ranked = dealt.withColumn("turn", F.row_number().over(in_cell))
    same_cell = same & (F.col("bucket") == F.col("of_bucket"))
    extra = (F.col("turn") <= F.col("raised")).cast("long")
    copies = F.when(F.col("size") > 0, F.shiftright("units", 20) + extra).otherwise(0).cast("long")
    rounded = ranked.join(raised, same_cell).select("doc_id", "source", "size", "bucket", "turn", copies.alias("copies"))
    return _settle(materialize(rounded), targets, int(cap))


def _settle(rounded: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Change one copy in each source where that brings it nearer to its target."""
    taken = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("all_taken"))
    sources = materialize(
        targets.join(taken.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
            F.col("source").alias("of"), F.col("total").alias("source_size"), "target", (F.col("target") - F.col("all_taken")).alias("gap")
        )
    )
    of_source = F.col("source").eqNullSafe(F.col("of"))
    allowed = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("gap") - F.col("size"))
    nearest = (
        rounded.join(sources, of_source).filter(allowed & (F.col("size") > 0) & (left < F.abs("gap")))
        .groupBy("source").agg(F.min(F.struct(left.alias("left"), F.xxhash64("doc_id").alias("mark"), "doc_id", "size", "bucket", "turn")).alias("pick"))
        .select(F.col("source").alias("changed"), "pick.*")
        .select("changed", *[F.col(c).alias(f"changed_{c}") for c in ("size", "bucket", "turn")])
    )
    picked = F.col("source").eqNullSafe(F.col("changed"))
    for c in ("size", "bucket", "turn"):
        picked = picked & (F.col(c) == F.col(f"changed_{c}"))
    step = F.when(F.col("changed_turn").isNull(), 0).otherwise(F.signum("gap").cast("long"))
    copies = F.col("copies") + step
    return rounded.join(nearest, picked, "left").join(sources, of_source).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies")
    )
