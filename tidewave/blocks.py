"""Builds of blocks: every stream of a recording block to its products, with an outcome per block.

A block ends done, quarantined (its data break a rule; a person must look) or failed (its
samples are broken); no block's trouble stops the others. All blocks are built together:
outcomes are decided by grouped checks over the tables, and the products of those that pass
are one job per pair of rates. Products, summaries and events are written under a
folder of the run; the outcomes, with hashes and counts of what was written, come last. A
reader follows the outcomes, so what a broken run leaves behind is never seen.

Tables: blocks (block_id, study_id, session, block), streams (block_id, stream, sfreq,
n_samples), chunks (block_id, stream, channel, t0_idx, x), events (block_id, label, i, onset,
offset, value).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import filters as K
from tidewave.operators import grid as G
from tidewave.operators.layout import classify_by_patterns
from tidewave.operators.privacy import text_violations, rules
from tidewave.storage import settled

KEYS = ("block_id", "stream", "channel")
#: Seconds, and share of its length, by which an event may lie past a block's end.
SLACK_S, SLACK_SHARE = 0.05, 0.01


@dataclass(frozen=True)
class BuildPolicy:
    """What becomes of a stream.

    roles: (pattern, role) of stream names; products: role to (product, target rate or None for
    native); native: patterns of event labels, or of block names, that keep a whole block at its
    native rates; dropped: event labels that aren't kept; redact: patterns of names that must
    not leave, beside those that never may.
    """

    roles: Sequence[tuple[str, str]]
    products: Mapping[str, tuple[str, float | None]]
    native: Sequence[str] = ()
    dropped: Sequence[str] = ()
    redact: Mapping[str, str] = field(default_factory=dict)
    spec: K.FilterSpec = K.FilterSpec()
    window_s: float = 30.0
    segment_s: float = 1.0

    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def native_blocks(blocks: DataFrame, events: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """block_id of blocks whose name, or one of whose event labels, fits a pattern."""
    none = F.lit(False)
    fits = lambda c: F.coalesce(F.greatest(none, *[F.col(c).rlike(p) for p in patterns]), none)
    named, told = blocks.where(fits("block")).select("block_id"), events.where(fits("label")).select("block_id")
    return named.union(told).distinct()


def plan_products(blocks: DataFrame, streams: DataFrame, events: DataFrame, policy: BuildPolicy) -> DataFrame:
    """block_id, stream, role, product, sfreq_in, sfreq_out, native, reason of every stream; role tells of unmapped and ambiguous ones."""
    roles = classify_by_patterns(streams, "stream", list(policy.roles))
    table = [(role, product, None if target is None else float(target)) for role, (product, target) in policy.products.items()]
    wanted = blocks.sparkSession.createDataFrame(table, "role string, product string, target double")
    stim = native_blocks(blocks, events, policy.native).withColumn("stim", F.lit(True))
    rows = roles.join(wanted, "role", "left").join(stim, "block_id", "left")
    own = F.col("stim").isNotNull() | F.col("target").isNull() | (F.col("target") >= F.col("sfreq"))
    reason = (
        F.when(F.col("stim").isNotNull(), "stimulation block: native rate").when(F.col("target").isNull(), "policy: native")
        .when(F.col("target") >= F.col("sfreq"), "target at or above native: never upsampled").otherwise("policy")
    )
    return rows.select(
        "block_id", "stream", "role", "product", F.col("sfreq").alias("sfreq_in"), F.when(own, F.col("sfreq")).otherwise(F.col("target")).alias("sfreq_out"),
        F.when(F.col("product").isNotNull(), own).alias("native"), F.when(F.col("product").isNotNull(), reason).alias("reason"), "n_samples",
    )


def _filters(plans: DataFrame, spec: K.FilterSpec) -> tuple[dict[tuple[float, float], tuple], DataFrame]:
    """The filter of every pair of rates, and the pairs that have none, with why. There are few pairs, however many blocks."""
    pairs = plans.where("not native").select("sfreq_in", "sfreq_out").distinct().limit(10_000).collect()
    found, bad = {}, []
    for a, b in sorted(map(tuple, pairs)):
        try:
            up, down = K.ratio(a, b)
            found[a, b] = (up, down, *K.antialias(up, down, a, spec))
        except K.RateNotRational as error:
            bad.append((a, b, "rate_not_rational", str(error)))
        except ValueError as error:
            bad.append((a, b, "filter_did_not_meet_spec", str(error)))
    return found, plans.sparkSession.createDataFrame(bad, "sfreq_in double, sfreq_out double, why string, detail string")


def judge_blocks(blocks: DataFrame, streams: DataFrame, chunks: DataFrame, events: DataFrame, plans: DataFrame, bad_rates: DataFrame, policy: BuildPolicy) -> DataFrame:
    """block_id, status, why, detail: the first rule that a block breaks, in a fixed order; broken samples fail it."""
    name = lambda rank, status, why, detail: F.struct(F.lit(rank).alias("rank"), F.lit(status).alias("status"), (why if not isinstance(why, str) else F.lit(why)).alias("why"), detail.alias("detail"))
    empty = blocks.select("block_id").join(streams.select("block_id"), "block_id", "left_anti").select("block_id", name(0, "quarantined", "no_streams", F.lit("")).alias("r"))
    odd = plans.where("role in ('unmapped', 'ambiguous')").select("block_id", name(1, "quarantined", F.concat(F.col("role"), F.lit("_stream")), F.col("stream")).alias("r"))
    kept = plans.where("product is not null").select("block_id").distinct()
    nothing = streams.select("block_id").distinct().join(kept, "block_id", "left_anti").select("block_id", name(2, "quarantined", "nothing_to_write", F.lit("")).alias("r"))
    rated = plans.where("not native").join(bad_rates, ["sfreq_in", "sfreq_out"]).select("block_id", name(3, "quarantined", F.col("why"), F.col("detail")).alias("r"))
    span = streams.groupBy("block_id").agg(F.max(F.col("n_samples") / F.col("sfreq")).alias("s"))
    clock = events.where(~F.col("label").isin(*policy.dropped) if policy.dropped else F.lit(True)).groupBy("block_id", "label").agg(F.min("onset").alias("lo"), F.max("onset").alias("hi"))
    clock = clock.join(span, "block_id").where((F.col("lo") < 0) | (F.col("hi") > F.col("s") * (1 + SLACK_SHARE) + SLACK_S))
    clock = clock.select("block_id", name(4, "quarantined", "epoch_clock_origin", F.format_string("%s: onsets from %.3f to %.3f s in a block of %.1f s", "label", "lo", "hi", "s")).alias("r"))
    used = rules(policy.redact)
    texts = streams.select("block_id", F.col("stream").alias("t")).union(events.select("block_id", "label")).distinct()
    private = texts.withColumn("v", text_violations(F.col("t"), used)).where(F.size("v") > 0).select("block_id", name(5, "quarantined", "private_name", F.array_join("v", ", ")).alias("r"))
    size = F.size("x")
    shape = chunks.groupBy(*KEYS).agg(
        F.sum(F.size(F.filter("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))).alias("bad"), F.sum(size).alias("n"), F.max(F.col("t0_idx") + size).alias("end"), F.min("t0_idx").alias("at")
    )
    short = shape.join(streams.select("block_id", "stream", "n_samples"), ["block_id", "stream"], "left")
    broken = short.where("bad > 0 or n <> end or at <> 0 or n_samples is null or n <> n_samples")
    why = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" samples are not finite"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" samples, not "), F.coalesce(F.col("n_samples").cast("string"), F.lit("?"))))
    failed = broken.select("block_id", name(6, "failed", "samples", F.concat("stream", F.lit("/"), "channel", F.lit(": "), why)).alias("r"))
    silent = streams.select("block_id", "stream").join(chunks.select("block_id", "stream").distinct(), ["block_id", "stream"], "left_anti")
    silent = silent.select("block_id", name(7, "failed", "samples", F.concat("stream", F.lit(": no samples"))).alias("r"))
    found = empty
    for more in (odd, nothing, rated, clock, private, failed, silent):
        found = found.unionByName(more)
    first = found.groupBy("block_id").agg(F.min("r").alias("r"))
    told = blocks.join(first, "block_id", "left")
    return told.select("block_id", F.coalesce("r.status", F.lit("done")).alias("status"), F.col("r.why").alias("why"), F.col("r.detail").alias("detail"))


def chunk_hashes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, sha256 of each series' samples in order, as 32-bit floats: chunks stream by, sorted."""
    types = dict(rows.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in by)
    ordered = rows.select(*by, "t0_idx", "x").repartition(*by).sortWithinPartitions(*by, "t0_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, running, schema = None, 0, hashlib.sha256(), None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in by), ("n", pa.int64()), ("sha256", pa.string())])
            done = []
            for i, own in enumerate(zip(*(batch[c].to_pylist() for c in by), strict=True)):
                if own != key:
                    if key is not None:
                        done.append((*key, n, running.hexdigest()))
                    key, n, running = own, 0, hashlib.sha256()
                x = batch["x"][i].values.to_numpy(zero_copy_only=False).astype("<f4")
                n += len(x)
                running.update(np.ascontiguousarray(x).tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, n, running.hexdigest()), strict=True))], schema=schema)

    return ordered.mapInArrow(run, f"{kinds}, n long, sha256 string")


def products_of(chunks: DataFrame, plans: DataFrame, filters: Mapping[tuple[float, float], tuple], window_s: float) -> DataFrame:
    """block_id, stream, channel, product, sfreq_out, t0_idx, x: every product's chunks; native ones as they are."""
    kept = plans.where("product is not null").select("block_id", "stream", "product", "sfreq_in", "sfreq_out", "native")
    rows = chunks.join(kept, ["block_id", "stream"])
    out = rows.where("native").select(*KEYS, "product", "sfreq_out", "t0_idx", "x")
    for (a, b), (up, down, taps, _) in filters.items():
        own = rows.where(~F.col("native") & (F.col("sfreq_in") == a) & (F.col("sfreq_out") == b))
        keys = [*KEYS, "product", "sfreq_out"]
        out = out.unionByName(G.resample(own.select(*keys, "t0_idx", "x"), keys, up, down, taps, max(1, round(window_s * a))))
    return out


def build_blocks(spark: SparkSession, blocks: DataFrame, streams: DataFrame, chunks: DataFrame, events: DataFrame, policy: BuildPolicy, path: str) -> DataFrame:
    """Builds all blocks under ``path`` and returns their outcomes, the run's rows of ``outcomes(path)``."""
    run = uuid.uuid4().hex
    plans = settled(plan_products(blocks, streams, events, policy))
    filters, bad = _filters(plans.where("product is not null"), policy.spec)
    judged = settled(judge_blocks(blocks, streams, chunks, events, plans, bad, policy))
    good = judged.where("status = 'done'").select("block_id")
    chosen = plans.where("product is not null").join(good, "block_id", "left_semi")
    native = chunks.join(chosen.select("block_id", "stream", "sfreq_in"), ["block_id", "stream"])
    folder = f"{path}/runs/{run}"

    narrow = F.transform("x", lambda v: v.cast("float"))
    products_of(chunks, chosen, filters, policy.window_s).withColumn("x", narrow).write.partitionBy("product").parquet(f"{folder}/products")
    # One width and segment per rate: spectra of a rate are alike.
    for rate in sorted(r[0] for r in chosen.select("sfreq_in").distinct().limit(10_000).collect()):
        segment = max(2, round(policy.segment_s * rate))
        states = G.window_states(native.where(F.col("sfreq_in") == rate), KEYS, max(segment, round(policy.window_s * rate)), rate, segment, segment // 2)
        held = settled(states)
        spectra = G.merge_spectra(held, KEYS).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "db"))), lambda v: v["db"]).alias("psd_db"))
        G.merge_states(held, KEYS).join(spectra, list(KEYS), "left").withColumn("sfreq", F.lit(rate)).write.mode("append").parquet(f"{folder}/summaries")
    kept = events.where(~F.col("label").isin(*policy.dropped)) if policy.dropped else events
    kept.join(good, "block_id", "left_semi").write.parquet(f"{folder}/events")

    written = spark.read.parquet(f"{folder}/products")
    hashes = chunk_hashes(written, ["block_id", "stream", "product", "channel"])
    line = F.concat_ws("/", "stream", "product", "channel", "n", "sha256")
    digests = hashes.groupBy("block_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"), F.countDistinct("stream", "product").alias("n_products"), F.sum("n").alias("n_samples")
    )
    # The outcomes are the commit: they are written when all they speak of is there.
    result = judged.join(digests, "block_id", "left").select(
        F.lit(run).alias("run"), F.current_timestamp().alias("built_at"), F.lit(policy.digest()).alias("policy"), "block_id", "status", "why", "detail", "sha256",
        F.coalesce("n_products", F.lit(0)).alias("n_products"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
    )
    result.write.mode("append").parquet(f"{path}/outcomes")
    return spark.read.parquet(f"{path}/outcomes").where(F.col("run") == run)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The latest outcome of every block."""
    rows = spark.read.parquet(f"{path}/outcomes")
    last = Window.partitionBy("block_id").orderBy(F.col("built_at").desc(), F.col("run").desc())
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def with_status(spark: SparkSession, path: str, status: str) -> DataFrame:
    """Blocks of one status, in order."""
    return outcomes(spark, path).where(F.col("status") == status).orderBy("block_id")


def outcome_of(spark: SparkSession, path: str, block_id: object) -> dict | None:
    """One block's latest outcome, or None."""
    row = outcomes(spark, path).where(F.col("block_id") == block_id).first()
    return None if row is None else row.asDict()


def needs_build(spark: SparkSession, blocks: DataFrame, policy: BuildPolicy, path: str) -> DataFrame:
    """Blocks without a done outcome under this policy."""
    try:
        done = outcomes(spark, path).where((F.col("status") == "done") & (F.col("policy") == policy.digest()))
    except AnalysisException:
        return blocks
    return blocks.join(done.select("block_id"), "block_id", "left_anti")


def read_built(spark: SparkSession, path: str, what: str) -> DataFrame:
    """products, summaries or events of the blocks that are done, each from the run of its latest outcome."""
    done = outcomes(spark, path).where("status = 'done'").select("block_id", "run")
    runs = sorted(r[0] for r in done.select("run").distinct().collect())
    if not runs:
        raise FileNotFoundError(f"no block below {path} is done")
    out = None
    for run in runs:
        rows = spark.read.parquet(f"{path}/runs/{run}/{what}").join(done.where(F.col("run") == run).select("block_id"), "block_id", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


def changed_products(spark: SparkSession, path: str) -> DataFrame:
    """block_id of done blocks whose products no longer have the hashes of their outcome."""
    line = F.concat_ws("/", "stream", "product", "channel", "n", "sha256")
    now = chunk_hashes(read_built(spark, path, "products"), ["block_id", "stream", "product", "channel"]).groupBy("block_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("now"))
    done = outcomes(spark, path).where("status = 'done'").join(now, "block_id", "left")
    return done.where(~F.col("sha256").eqNullSafe(F.col("now"))).select("block_id")
