"""What detection concludes about a recording: proposals with confidence, evidence and alternatives.

A proposal is (subject, field, value, confidence, band, prefill, alternatives, evidence,
detectable, reason). What measurement can't tell apart stays a set to choose from: the value
is then the placeholder, never the first name by alphabet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.layout import geometry

HIGH, MEDIUM = 0.9, 0.6
PLACEHOLDER = "unknown"
COLUMNS = ("field", "value", "confidence", "band", "prefill", "alternatives", "evidence", "detectable", "reason")


def band(confidence: Column, detectable: Column) -> Column:
    return F.when(~detectable, "not detectable").when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def proposal(rows: DataFrame, by: Sequence[str], field: str, value: Column, confidence: Column, evidence: Mapping[str, Column], reason: Column, alternatives: Column | None = None, detectable: Column | None = None) -> DataFrame:
    """Rows as proposals of one schema; a value is preselected only where it is detectable and sure."""
    known = F.lit(True) if detectable is None else detectable
    said = F.map_from_arrays(F.array(*[F.lit(k) for k in evidence]), F.array(*[v.cast("string") for v in evidence.values()]))
    none = F.array().cast("array<string>")
    return rows.select(
        *by, F.lit(field).alias("field"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), band(confidence, known).alias("band"),
        (known & (confidence >= HIGH)).alias("prefill"), (none if alternatives is None else F.coalesce(alternatives, none)).alias("alternatives"), said.alias("evidence"),
        known.alias("detectable"), reason.alias("reason"),
    )


def needs_selection(proposals: DataFrame) -> DataFrame:
    """Those that a person must decide: not detectable, or not sure."""
    return proposals.where(~F.col("prefill"))


def by_field(proposals: DataFrame, field: str) -> DataFrame:
    return proposals.where(F.col("field") == field)


def expected_contacts(leads: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, contact: every contact from channel_first to channel_last."""
    return leads.select(*by, F.explode(F.sequence("channel_first", "channel_last")).alias("contact"))


def missing_contacts(sweep: DataFrame, leads: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, contact: contacts of the leads that the sweep has no impedance for."""
    return expected_contacts(leads, by).join(sweep.where("kohm is not null").select(*by, "contact"), [*by, "contact"], "left_anti")


def contact_labels(sweep: DataFrame, leads: DataFrame, by: Sequence[str], ratio: float = 1.5) -> DataFrame:
    """by, contact, kohm, kind: ring, segment (``ratio`` times the lead's least impedance or more) or unknown (not measured)."""
    every = expected_contacts(leads, by).join(sweep.select(*by, "contact", "kohm"), [*by, "contact"], "left")
    least = every.groupBy(*by).agg(F.min("kohm").alias("_least"))
    kind = F.when(F.col("kohm").isNull(), "unknown").when(F.col("kohm") >= F.col("_least") * ratio, "segment").otherwise("ring")
    return every.join(least.where("_least is not null"), list(by)).withColumn("kind", kind).drop("_least")


def propose_lead_models(sweep: DataFrame, leads: DataFrame, models: DataFrame, by: Sequence[str], ratio: float = 1.5) -> DataFrame:
    """The lead model of each lead, from the rows of rings and segments that its impedances tell.

    sweep: by, contact, kohm; leads: by, channel_first, channel_last; models: model, geometry
    (array of rows), n_contacts. A lead meets the models of its geometry and size by equality.
    One specific model and no placeholder: proposed surely. Several, or a placeholder among
    them: the placeholder is proposed, and the specific ones are alternatives. None: no value.
    """
    labels = contact_labels(sweep, leads, by, ratio)
    # An unmeasured contact is a row of its own, as a ring is.
    rows = geometry(labels.withColumn("kind", F.when(F.col("kind") == "segment", "segment").otherwise("ring")), list(by), "contact")
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("kohm")))
    facts = labels.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_contacts"), mean("ring").alias("ring"), mean("segment").alias("segment"),
        F.transform(F.array_sort(F.collect_list(F.struct("contact", "kind", "kohm"))), lambda c: c["kind"]).alias("kinds"),
    )
    measured = leads.select(*by).join(facts, list(by), "left").join(rows, list(by), "left")
    shape = F.array_join(F.transform("geometry", lambda v: v.cast("string")), "-")
    keyed = models.select("model", F.array_join(F.transform("geometry", lambda v: v.cast("string")), "-").alias("_shape"), F.col("n_contacts").cast("int").alias("_n"))
    measured = measured.withColumn("shape", F.coalesce(shape, F.lit("")))
    placeholder = F.col("model").startswith(PLACEHOLDER)
    met = measured.join(keyed, (F.col("shape") == F.col("_shape")) & (F.col("n_contacts") == F.col("_n")), "left")
    fitting = met.groupBy(*by, "shape", "ring", "segment", "kinds").agg(
        F.min(F.when(placeholder, F.col("model"))).alias("open"), F.array_sort(F.collect_set(F.when(~placeholder, F.col("model")))).alias("named")
    )
    n = F.size("named")
    sure = (n == 1) & F.col("open").isNull()
    none = (n == 0) & F.col("open").isNull()
    evidence = {
        "geometry": F.col("shape"), "labels": F.array_join("kinds", ","), "ring_mean_kohm": F.round("ring", 2), "segment_mean_kohm": F.round("segment", 2),
        "segment_to_ring": F.round(F.try_divide("segment", "ring"), 2),
    }
    reason = (
        F.when(none, F.concat(F.lit("no configured model has the rows "), "shape"))
        .when(sure, F.concat(F.lit("one configured model has the rows "), "shape"))
        .otherwise(F.concat(F.lit("the rows "), "shape", F.lit(" are measured, the maker is not: "), n.cast("string"), F.lit(" models have them")))
    )
    confidence = F.when(none, 0.0).when(sure, HIGH).otherwise(MEDIUM)
    value = F.when(sure, F.get("named", F.lit(0))).otherwise(F.col("open"))
    alternatives = F.when(~sure, F.col("named"))
    return proposal(fitting, by, "lead_model", value, confidence, evidence, reason, alternatives)


def propose_contact_quality(contacts: DataFrame, by: Sequence[str], target: Column, worst: Column, open_kohm: float = 100.0, high_kohm: float = 25.0) -> DataFrame:
    """Contacts, or differential channels by their worse electrode, that are open or poorly connected."""
    rows = contacts.withColumn("_w", worst).withColumn("_t", target).where(F.col("_w") >= min(open_kohm, high_kohm))
    broken = F.col("_w") >= open_kohm
    reason = F.when(broken, F.format_string("%s kOhm: no connection is seen", "_w")).otherwise(F.format_string("%s kOhm: usable, but noisy", "_w"))
    return proposal(rows, by, "contact_quality", F.when(broken, "open_circuit").otherwise("high_impedance"), F.when(broken, HIGH).otherwise(MEDIUM), {"target": F.col("_t"), "kohm": F.col("_w")}, reason)
