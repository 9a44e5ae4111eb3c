"""Mixing sources to target weights along a time-varying curriculum.

A schedule gives every source a weight at knots 0 = t0 < ... < tk = 1 of training;
between knots weights run straight. Its integral A_s(t) is the source's cumulative
demand: over the whole run source s is due T * A_s(1) / sum(A(1)) words of the T
words trained. No target exceeds ``max_repeats`` times its source's size; what is
over is shared among the others by weight until no target is above (water filling:
sources in order of size per weight, one prefix sum).

Within a source documents stand in a fixed pseudo-random order (by md5 of the
source and doc_id) and follow each other, pass after pass. A document's copy whose
middle lies at c words into the source's demand is trained at the time t at which
A_s(t) / A_s(1) = c / target_s. Copies whose time lies beyond the end of training aren't
taken, so a source misses its target by half a document at most. Sorting all
copies by t (a range sort) gives the training order.

The running sums are two-level: documents are dealt to sqrt(rows) buckets of the
order within each source, bucket sums are added up per source, then documents
within a bucket. Both group sizes grow with the square root of the input, so a
source with a third of all rows is no single task. The schedule and source tables
have one row per source; they are joined under Spark's own size check.

Defined results for odd input: null text counts 0 words, is taken 0 times and has
no position; null source is a source of its own, last in order; null doc_ids are
ordered by their
text's digest, so that a source of rows without ids spreads like any other; repeated rows are separate copies and come next to each
other; equal positions are ordered by source, then doc_id; an empty table or no
words at all gives targets of 0; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.llm.common import WORD_PATTERN, cut, require, table

#: Weights of the op1 contract, repeated over the sources in order.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def order_key(source: Column, doc_id: Column, text: Column) -> Column:
    """60 pseudo-random bits of a document, the same in every run and engine; its text stands for a missing id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit("/"), name))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def cyclic_schedule(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """A constant schedule: sources by code point, null last, weigh ``weights`` in turn.

    The one ordered window here holds a row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return sources.select("source", F.array(F.struct(F.lit(0.0).alias("t"), weight.alias("w")),
                                            F.struct(F.lit(1.0).alias("t"), weight.alias("w"))).alias("knots"))


def source_targets(sizes: DataFrame, schedule: DataFrame, max_repeats: int, total: float | None = None) -> DataFrame:
    """source, source_size, knots (with integrals), area and target of every source.

    knots are (t, w, a): time, weight and the integral of the weight up to t.
    """
    start = F.array(F.struct(F.lit(0.0).alias("t"), F.element_at("knots", 1)["w"].alias("w"), F.lit(0.0).alias("a")))

    def step(done: Column, knot: Column) -> Column:
        last = F.element_at(done, -1)
        area = last["a"] + (knot["t"] - last["t"]) * (knot["w"] + last["w"]) / 2
        return F.concat(done, F.array(F.struct(knot["t"].alias("t"), knot["w"].alias("w"), area.alias("a"))))

    joined = (
        sizes.join(schedule.select(F.col("source").alias("s"), "knots"), F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source", "source_size", F.aggregate(F.expr("slice(knots, 2, size(knots))"), start, step).alias("knots"))
        .withColumn("area", F.coalesce(F.element_at("knots", -1)["a"], F.lit(0.0)))
    )
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(
        F.try_divide(F.col("cap"), F.col("area")).asc_nulls_first(), F.col("source").asc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, -1)
    sums = joined.withColumn("cap", max_repeats * F.col("source_size").cast("double")).withColumns(
        {
            "all_words": F.lit(float(total)) if total is not None else F.sum("source_size").over(whole).cast("double"),
            "all_area": F.sum("area").over(whole),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "area_before": F.coalesce(F.sum("area").over(before), F.lit(0.0)),
        }
    )
    # Above its cap even if all sources with less room per weight are at theirs.
    above = F.col("area") * (F.col("all_words") - F.col("cap_before")) > F.col("cap") * (
        F.col("all_area") - F.col("area_before")
    )
    held = sums.withColumn("held", above)
    share = held.withColumns(
        {
            "left_words": F.col("all_words") - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(whole), F.lit(0.0)),
            "left_area": F.sum(F.when(F.col("held"), F.lit(0.0)).otherwise(F.col("area"))).over(whole),
        }
    )
    target = F.when(F.col("held"), F.col("cap")).otherwise(
        F.coalesce(F.try_divide(F.col("area") * F.col("left_words"), F.col("left_area")), F.lit(0.0))
    )
    return share.select("source", "source_size", "knots", "area", F.least(target, "cap").alias("target"))


def demand_time(knots: Column, area: Column) -> Column:
    """The time at which the integrated schedule reaches ``area``: one quadratic."""
    n = F.size(knots)
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(knots, lambda x: x["a"] <= area))))
    lo, hi = F.element_at(knots, k), F.element_at(knots, k + 1)
    rest, slope = area - lo["a"], (hi["w"] - lo["w"]) / (hi["t"] - lo["t"])
    # rest = w*dt + slope*dt^2/2, solved without dividing by a slope of 0
    root = F.sqrt(F.greatest(lo["w"] * lo["w"] + 2 * slope * rest, F.lit(0.0)))
    return lo["t"] + F.coalesce(F.try_divide(2 * rest, lo["w"] + root), F.lit(0.0))


def mix_sources(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedule: DataFrame | None = None,
    max_repeats: int = MAX_REPEATS,
    total: float | None = None,
) -> DataFrame:
    """Every document with its copies' training times.

    Returns doc_id, source, size, source_size, target, taken (words over all
    copies) and positions, the times of its copies in [0, 1] (empty if not taken).
    schedule: source, knots array<struct<t,w>> from t=0 to t=1; without one,
    constant ``weights`` in turn. total: words to train, as many as there are if None.
    """
    require(documents, ["doc_id", "text", "source"])
    slim = cut(
        documents.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("o")
        )
    )
    buckets = max(1, round(slim.count() ** 0.5))
    dealt = slim.withColumn("bucket", F.floor(F.col("o") / F.lit(float(1 << 60)) * buckets).cast("int"))

    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    in_source = W.partitionBy("source")
    offsets = sums.withColumns(
        {
            "bucket_start": F.sum("words").over(in_source.orderBy("bucket")) - F.col("words"),
            "source_size": F.sum("words").over(in_source),
        }
    )
    sizes = dealt.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = schedule if schedule is not None else cyclic_schedule(sizes, weights)
    targets = source_targets(sizes, plan, max_repeats, total)
    places = offsets.drop("source_size").join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left"
    ).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "source_size", "knots", "area", "target")

    inside = W.partitionBy("source", "bucket").orderBy("o", F.col("doc_id").asc_nulls_first(), "size")
    placed = dealt.withColumn("inside", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    joined = placed.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    middle = F.col("bucket_start") + F.col("inside") + F.col("size") / 2
    # The time of each copy, by inverting the integral; a copy beyond the source's demand has none.
    demand = lambda e: F.try_divide((e * F.col("source_size") + middle) * F.col("area"), F.col("target"))
    times = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: demand_time(F.col("knots"), demand(e)))
    taken = F.filter(times, lambda t: (F.col("size") > 0) & (t < 1.0))
    return joined.withColumn("positions", taken).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions"
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by its training time."""
    copies = mixed.select("doc_id", "source", "size", F.explode("positions").alias("position"))
    return copies.orderBy("position", F.col("source").asc_nulls_last(), "doc_id")


def in_order_of_first_copy(mixed: DataFrame) -> DataFrame:
    """The mixed documents, range-sorted by the position of their first copy; those not taken come last."""
    first = F.try_element_at("positions", F.lit(1)).alias("position")
    ordered = mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order_of_first_copy(mix_sources(table(spark, sf_dir, "documents")))


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(source, '') || '/' || coalesce(doc_id::varchar, '?' || md5(coalesce(text, '')))), 1, 15))::bigint as o
  from {documents}
), sources as (
  select source, sum(size)::bigint as source_size,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from sized group by source
), ordered as (
  select *, 3 * source_size::double as cap,
    (sum(source_size) over ())::double as t, sum(w) over () as wt from sources
), filled as (
  select *, coalesce(sum(cap) over before, 0) as c0, coalesce(sum(w) over before, 0) as w0 from ordered
  window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), held as (
  select *, w * (t - c0) > cap * (wt - w0) as held from filled
), targets as (
  select source, source_size, w, case when held then cap else least(cap, coalesce(w *
    (t - coalesce(sum(case when held then cap end) over (), 0)) / nullif(sum(case when held then 0 else w end) over (), 0), 0)) end as target
  from held
), placed as (
  select doc_id, source, size, (sum(size) over (partition by source order by o, doc_id nulls first, size
    rows between unbounded preceding and current row)) - size as start from sized
), copies as (
  select p.doc_id, p.size, t.source_size, t.target, list_filter(
    [2 * ((e * t.source_size + p.start + p.size / 2) * w / nullif(t.target, 0)) / (w + sqrt(w * w)) for e in range(0, 3)], lambda x: p.size > 0 and x < 1) as positions
  from placed p join targets t on p.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * len(positions))::bigint as taken, round(positions[1], 9) as position
from copies
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": ORACLE.format(documents="documents")}
