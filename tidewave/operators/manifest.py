"""The manifest: six tables of text that say what was recorded, and the rules they keep.

``problems`` returns every violation as a row, so that one pass of editing can mend them
all. Tables are read as text with blanks trimmed; a missing file is an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators.catalog import to_bool

#: The tables and their columns.
TABLES = {
    "subjects": "study_id session hemisphere format root_relpath acquisition acquisition_date notes",
    "streams": "study_id session stream n_channels sfreq_hz units role relpath notes",
    "leads": "study_id session lead_id target hemisphere lead_model channel_first channel_last rotation_deg notes",
    "channels": "study_id session stream ch_index ch_name region lead_id lead_contact site include exclude_reason",
    "windows": "study_id session condition t_start_s t_end_s derived_from status notes",
    "coordinates": "study_id session lead_id contact x_mm y_mm z_mm space source",
}
KEY = ["study_id", "session"]
Tables = Mapping[str, DataFrame]


def columns_of(table: str) -> list[str]:
    return TABLES[table].split()


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of a folder of CSV files, by their headers; columns a file lacks are empty."""
    out = {}
    for name in TABLES:
        names = columns_of(name)
        try:
            rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{folder}/{name}.csv")
        except AnalysisException:
            rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in names))
        out[name] = rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) if c in rows.columns else F.lit("").alias(c) for c in names])
    return out


def subject_keys(tables: Tables) -> DataFrame:
    return tables["subjects"].select(*KEY).distinct()


def channels_for(tables: Tables, study_id: str, session: str) -> DataFrame:
    return tables["channels"].where((F.col("study_id") == study_id) & (F.col("session") == session))


def included(channels: DataFrame) -> DataFrame:
    """Channels marked to be used; anything but a plain yes is a no."""
    return channels.where(F.coalesce(to_bool(F.col("include")), F.lit(False)))


def model_contacts(spark: SparkSession, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """lead_model, contacts of a configuration of lead models."""
    return spark.createDataFrame([(k, [str(c) for c in v]) for k, v in models.items()], "lead_model string, contacts array<string>")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _found(rows: DataFrame, table: str, item: Column, problem: str, warn: bool = False) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"), *KEY, F.coalesce(item.cast("string"), F.lit("")).alias("item"), F.lit("warning" if warn else "error").alias("severity"), F.lit(problem).alias("problem")
    )


def _not_in(column: str, words: Sequence[str]) -> Column:
    return ~F.coalesce(F.col(column).isin(*words), F.lit(False))


def problems(tables: Tables, models: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """table, study_id, session, item, severity, problem: everything that breaks a rule.

    models: lead_model, contacts. vocabulary: regions, conditions, window_sources, window_status,
    coordinate_spaces, coordinate_sources; a list that isn't given is not checked.
    """
    subjects, streams, leads, channels, windows, places = (tables[t] for t in ("subjects", "streams", "leads", "channels", "windows", "coordinates"))
    keys, out = subject_keys(tables), []
    for table, item in (("streams", "stream"), ("leads", "lead_id"), ("channels", "ch_index"), ("windows", "condition"), ("coordinates", "contact")):
        out.append(_found(tables[table].join(keys, KEY, "left_anti"), table, F.col(item), "no row in subjects"))
    out.append(_found(subjects.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "subjects", F.lit(""), "more than one row"))

    # Channel numbers: whole, from 1, within the stream, once each however they are written.
    index = F.col("ch_index").try_cast("int")
    whole = F.col("ch_index").rlike(r"^[+-]?\d+$") & index.isNotNull()
    numbered = channels.withColumn("index", F.when(whole, index))
    out.append(_found(numbered.where("index is null"), "channels", F.col("ch_index"), "ch_index is not an integer"))
    out.append(_found(numbered.where("index < 1"), "channels", F.col("ch_index"), "ch_index counts from 1"))
    sizes = streams.select(*KEY, "stream", F.col("n_channels").try_cast("int").alias("declared")).groupBy(*KEY, "stream").agg(F.max("declared").alias("declared"))
    sized = numbered.where("index >= 1").join(sizes, [*KEY, "stream"], "left")
    out.append(_found(sized.where("index > declared"), "channels", F.col("ch_index"), "ch_index is beyond the stream's channels"))
    twice = sized.where("declared is null or index <= declared").groupBy(*KEY, "stream", "index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out.append(_found(twice, "channels", F.col("index"), "ch_index is there more than once"))
    counted = channels.groupBy(*KEY, "stream").agg(F.count(F.lit(1)).alias("rows"))
    held = counted.join(streams.select(*KEY, "stream", F.col("n_channels").try_cast("int").alias("declared"), F.lit(True).alias("known")), [*KEY, "stream"], "left")
    out.append(_found(held.where("known is null"), "channels", F.col("stream"), "no row in streams"))
    out.append(_found(held.where("declared <> rows"), "streams", F.col("stream"), "n_channels differs from the rows of channels"))

    use = to_bool(F.col("include"))
    out.append(_found(channels.where(use.isNull()), "channels", F.col("ch_index"), "include must be true or false"))
    out.append(_found(channels.where((use == F.lit(False)) & _blank("exclude_reason")), "channels", F.col("ch_index"), "excluded without a reason"))
    if vocabulary.get("regions"):
        out.append(_found(channels.where(~_blank("region") & _not_in("region", vocabulary["regions"])), "channels", F.col("region"), "unknown region"))

    # Leads: models that are defined, ranges of their length, contacts that are theirs.
    modelled = leads.join(models, "lead_model", "left")
    out.append(_found(modelled.where("contacts is null"), "leads", F.col("lead_model"), "lead_model is not defined"))
    span = F.col("channel_last").try_cast("int") - F.col("channel_first").try_cast("int") + 1
    defined = modelled.where("contacts is not null")
    out.append(_found(defined.where(span.isNull()), "leads", F.col("lead_id"), "channel_first and channel_last must be integers"))
    out.append(_found(defined.where(span != F.size("contacts")), "leads", F.col("lead_id"), "the channel range differs from the model's contacts"))
    out.append(_found(defined.where(_blank("rotation_deg")), "leads", F.col("lead_id"), "rotation_deg is empty: no claims of direction", warn=True))
    known = modelled.select(*KEY, "lead_id", "contacts", F.lit(True).alias("lead")).dropDuplicates([*KEY, "lead_id"])
    wired = channels.where(~_blank("lead_id")).join(known, [*KEY, "lead_id"], "left")
    out.append(_found(wired.where("lead is null"), "channels", F.col("lead_id"), "no row in leads"))
    odd = ~_blank("lead_contact") & ~F.array_contains("contacts", F.col("lead_contact"))
    out.append(_found(wired.where(odd), "channels", F.col("lead_contact"), "not a contact of the lead's model"))

    located = places.join(known, [*KEY, "lead_id"], "left")
    out.append(_found(located.where("lead is null"), "coordinates", F.col("lead_id"), "no row in leads"))
    there = located.where("lead is not null")
    out.append(_found(there.where(~F.array_contains("contacts", F.col("contact"))), "coordinates", F.col("contact"), "not a contact of the lead's model"))
    out.append(_found(there.groupBy(*KEY, "lead_id", "contact").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "coordinates", F.col("contact"), "more than one row"))
    for axis in ("x_mm", "y_mm", "z_mm"):
        out.append(_found(there.where(F.col(axis).try_cast("double").isNull()), "coordinates", F.col("contact"), f"{axis} must be a number"))
    out.append(_found(there.where(F.col("space") == "native"), "coordinates", F.col("contact"), "a native space isn't comparable across subjects", warn=True))

    for table, rows, column, words in (
        ("coordinates", there, "space", "coordinate_spaces"), ("coordinates", there, "source", "coordinate_sources"), ("windows", windows, "condition", "conditions"),
        ("windows", windows, "derived_from", "window_sources"), ("windows", windows, "status", "window_status"),
    ):
        if vocabulary.get(words):
            out.append(_found(rows.where(_not_in(column, vocabulary[words])), table, F.col(column), f"unknown {column}"))
    out.append(_found(windows.where("derived_from = 'assumed'"), "windows", F.col("condition"), "assumed, not measured", warn=True))
    out.append(_found(windows.where("status = 'under_revision'"), "windows", F.col("condition"), "under revision", warn=True))
    timed = windows.withColumns({"t0": F.col("t_start_s").try_cast("double"), "t1": F.col("t_end_s").try_cast("double")})
    out.append(_found(timed.where("t0 is null or t1 is null"), "windows", F.col("condition"), "t_start_s and t_end_s must be numbers"))
    out.append(_found(timed.where("t1 <= t0"), "windows", F.col("condition"), "t_end_s must exceed t_start_s"))
    order = W.partitionBy(*KEY, "condition").orderBy("t0", "t1")
    overlap = timed.where("t0 is not null and t1 is not null").withColumn("next", F.lead("t0").over(order)).where("next < t1")
    out.append(_found(overlap, "windows", F.col("condition"), "overlaps the next window of its condition"))

    whole_ = out[0]
    for part in out[1:]:
        whole_ = whole_.union(part)
    return whole_


def commit(old: Tables, drafted: Tables, models: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with drafted subjects and streams added, and the errors they would have; keys that are there already are errors."""
    merged = {**old, **{t: old[t].unionByName(drafted[t].select(*columns_of(t))) for t in ("subjects", "streams")}}
    return merged, problems(merged, models, vocabulary).where("severity = 'error'")


def draft(chunks: DataFrame) -> dict[str, DataFrame]:
    """subjects and streams from what recordings hold (chunks as of sources.recordings.read_chunks).

    A recording lies in a folder, which is the session, within the study's folder. What can't be
    read is listed under unreadable.
    """
    at = F.split("path", "/")
    named = chunks.withColumns({"study_id": F.element_at(at, -3), "session": F.element_at(at, -2)})
    read = named.where("error is null")
    streams = read.groupBy(*KEY, "stream").agg(
        F.count_distinct("channel").cast("string").alias("n_channels"), F.first("sfreq").cast("string").alias("sfreq_hz")
    )
    subjects = read.groupBy(*KEY).agg(F.first("format").alias("format"))
    subjects = subjects.withColumns({"root_relpath": F.concat_ws("/", *KEY), "acquisition": F.col("session")})
    out = {}
    for name, rows in (("subjects", subjects), ("streams", streams)):
        out[name] = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns_of(name)])
    out["unreadable"] = named.where("error is not null").select(*KEY, "error")
    return out
