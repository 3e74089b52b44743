"""Mixing sources to target weights by entropy balancing.

Among all document rates that meet a source's token target, those nearest to one copy each (in relative entropy) have
the form exp(lambda * size / scale). Newton iterations on the convex dual find each source's lambda; every iteration
is one aggregate over (source, size) counts. Rates are rounded to copies so that a source's words meet its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, keys128, materialize, running, spare

WEIGHTS, CAP = (5, 2, 1), 3
#: Fixed-point units of a rate: sums of whole numbers don't depend on the order of adding, so reruns agree.
UNIT = 1_000_000
BINS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target), one row a source, for rows (source, size).

    Sources by code point, null last, get the weights in turn and share the sum of all sizes in proportion, but none
    above cap times its own size: what it cannot take is shared anew by weight. That ends where each source gets the
    lesser of cap * size and level * weight, so the level is read from running sums over sources by cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    most = (cap * F.col("source_size")).cast("double")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = running(per, [F.col("source").asc_nulls_first()])
    # null sorts first there and last here
    nulls = F.col("source").isNull().cast("long")
    has_null, n, everything = per.agg(F.max(nulls), F.count("*"), F.sum("source_size")).first()
    weighed = weighed.withColumn("nth", F.when(nulls == 1, F.lit(n - 1)).otherwise(F.col("nth") - F.lit(has_null or 0))).select("source", "source_size", weight.alias("weight"))
    by = [(most / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    levels = materialize(running(weighed, by, capped=cap * F.col("source_size"), weighs=F.col("weight")), "levels")
    all_ = levels.agg(F.sum("weight")).first()[0]
    level = (F.lit(everything) - F.col("capped")) / (F.lit(all_) - F.col("weighs"))
    free = levels.select("nth", level.alias("level")).where(level * F.col("weight") <= most).agg(F.min(F.struct("nth", "level")).alias("x")).first()["x"]
    top = F.least(F.lit(free["level"]) * F.col("weight"), most) if free else most
    return levels.select("source", "source_size", top.alias("target"))


def _rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    return F.least(F.exp(F.least(lam * size / scale, F.lit(50.0))), F.lit(float(cap)))


def _lambdas(sizes: DataFrame, targets: DataFrame, cap: int, rounds: int) -> DataFrame:
    """(source, source_size, target, scale, lam): Newton steps kept within the bracket known so far."""
    hist = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")).filter("size > 0"), "sizes")
    scale = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    state = targets.join(scale, targets["source"].eqNullSafe(scale["source"]), "left").drop(scale["source"])
    state = state.withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "lam": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0)})
    state = materialize(state, "state")
    for _ in range(rounds):
        joined = hist.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        unit = lambda x: F.round(x * UNIT).cast("decimal(20,0)")
        mass = F.col("n").cast("decimal(12,0)") * F.col("size").cast("decimal(10,0)")
        slope = F.when(rate < cap, rate * F.col("size") / F.col("scale")).otherwise(0.0)
        got = joined.groupBy("s").agg(F.sum((mass.cast("decimal(18,0)") * unit(rate)).cast("decimal(38,0)")).alias("f"), F.sum((mass.cast("decimal(18,0)") * unit(slope)).cast("decimal(38,0)")).alias("g"))
        step = state.join(got, state["source"].eqNullSafe(got["s"]), "left").drop("s")
        gap = F.col("f").cast("double") / UNIT - F.col("target")
        step = step.withColumns({"gap": F.coalesce(gap, F.lit(0.0)), "g": F.coalesce(F.col("g").cast("double") / UNIT, F.lit(0.0))})
        step = step.withColumns({"low": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - F.col("gap") / F.nullif(F.col("g"), F.lit(0.0))
        middle = (F.col("low") + F.col("high")) / 2
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        new = F.when(F.abs("gap") <= 1e-6 * F.col("target"), F.col("lam")).otherwise(F.when(inside, newton).otherwise(middle))
        new_state = materialize(step.select("source", "source_size", "target", "scale", F.round(new, 9).alias("lam"), "low", "high", "gap"), "state")
        open_ = new_state.filter((F.abs("gap") > 1e-6 * F.col("target")) & (F.col("high") - F.col("low") > 1e-8) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-9))).isEmpty()
        discard(state)
        state = new_state.drop("gap")
        state._tessera_path = new_state._tessera_path
        if open_:
            break
    else:
        raise RuntimeError(f"the rates did not settle in {rounds} rounds")
    return state.withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-9), F.lit(60.0)).otherwise(F.col("lam")))


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, rounds: int = 80) -> DataFrame:
    """(doc_id, k2, k3, source, size, source_size, target, rate, copies, part, taken) for every row of docs.

    size: words of the whole text (null text: 0). copies: whole times the mix takes the document; part: words of one
    further, trimmed copy, which at most one document a source has, so that the source's words meet its target;
    taken = copies * size + part, at most cap * size. The fraction of a rate gives a further copy to the documents whose
    fraction most exceeds their hash, as far as the target allows; the turning point is found in BINS sums a source, and
    only the documents of that one bin are put in order. Repeated rows are documents of their own; an empty table gives
    no row. Null sources are one source. k2, k3 are 128 bits of hash of the row's columns, any of which may have any
    name but these; rows that are equal in all of them are interchangeable, others are told apart. A long text takes time
    only. Raises if Newton's iterations have not settled after `rounds`.
    """
    k2, k3 = keys128(*docs.columns)
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), k2.alias("k2"), k3.alias("k3"), size.alias("size")), "mix")
    solved = _lambdas(sizes, source_targets(sizes, weights, cap), cap, rounds)
    joined = sizes.join(solved.select(F.col("source").alias("s"), "source_size", "target", "scale", "lam"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rated = joined.withColumn("rate", F.round(_rate(F.col("lam"), F.col("size"), F.col("scale"), cap), 6)).withColumn("copies", F.floor("rate").cast("long"))
    draw = F.pmod(F.xxhash64("doc_id", "k2", "k3", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rated = rated.withColumn("edge", F.when((F.col("size") > 0) & (F.col("copies") < cap), F.col("rate") - F.col("copies") - draw))
    rated = rated.withColumn("bin", F.floor((1 - F.col("edge")) / 2 * BINS).cast("int")).drop("lam", "scale")
    per_bin = rated.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.sum(F.col("copies") * F.col("size")).alias("bin_base"), F.first("target").alias("t"))
    by_source = Window.partitionBy("source")
    need = F.greatest(F.round(F.col("t")) - F.sum("bin_base").over(by_source), F.lit(0.0)).cast("long")
    before = F.sum(F.when(F.col("bin").isNotNull(), F.col("bin_size"))).over(by_source.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    bins = per_bin.withColumns({"need": need, "before": F.coalesce(before, F.lit(0))}).filter("bin is not null")
    # bins are taken whole up to the first that holds more than there is room for: one row a source
    stops = bins.withColumn("room", F.col("need") - F.col("before")).filter("room < bin_size").groupBy("source").agg(F.min(F.struct("bin", "room")).alias("stop"))
    stops = stops.select(F.col("source").alias("s"), F.col("stop.bin").alias("at"), F.col("stop.room").alias("room"))
    dealt = rated.join(stops, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    turning = F.coalesce((F.col("bin") == F.col("at")) & (F.col("room") > 0), F.lit(False))
    ahead = F.sum("size").over(Window.partitionBy("source").orderBy(F.col("edge").desc(), "doc_id", "k2", "k3").rowsBetween(Window.unboundedPreceding, -1))
    inner = dealt.filter(turning).withColumn("left_", F.col("room") - F.coalesce(ahead, F.lit(0)))
    inner = inner.withColumn("more", F.when(F.col("left_") >= F.col("size"), F.col("size")).otherwise(F.greatest("left_", F.lit(0)))).drop("left_")
    taken = F.col("bin").isNotNull() & (F.col("at").isNull() | (F.col("bin") < F.col("at")))
    outer = dealt.filter(~turning).withColumn("more", F.when(taken, F.col("size")).otherwise(0))
    both = inner.unionByName(outer)
    whole = (F.col("size") > 0) & (F.col("more") == F.col("size"))
    both = both.withColumns({"copies": F.col("copies") + whole.cast("long"), "part": F.when(whole, 0).otherwise(F.col("more")).cast("long")})
    return both.select("doc_id", "k2", "k3", "source", "size", "source_size", "target", "rate", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def repeat_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it; a trimmed copy counts if it holds half of the document.

    Rows that are equal in all columns are taken together: the sum of their copies stands for them all. Columns are
    kept, whatever their names; an empty table stays empty.
    """
    whole = F.col("copies") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    names = spare(docs, "k2", "k3", "times", "copy")
    times = mix_documents(docs, weights, cap).groupBy("k2", "k3").agg(F.sum(whole).alias("n")).filter("n > 0").toDF(*names[:3])
    keyed = docs.withColumns(dict(zip(names[:2], keys128(*docs.columns), strict=True))).dropDuplicates(names[:2])
    return keyed.join(times, names[:2]).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[2]))).alias(names[3])).drop(names[3])
