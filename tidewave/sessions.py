"""One recording with what the manifest and the configurations say about it.

A session holds tables, not samples: its windows, leads and channels are DataFrames, and
signals derived from its leads are plans over chunks. It also states what the guardrails
may know of an analysis before anything is computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators import catalog, events, formulas, grid, manifest, privacy
from tidewave.operators.layout import epoch_bounds


@dataclass(frozen=True)
class Session:
    study_id: str
    session: str
    format: str
    path: str
    tables: Mapping[str, DataFrame]
    configs: Mapping[str, Mapping]
    contacts: DataFrame  # lead, contact, row, pos, kind, row_label, stream, channel, available
    applied: tuple[dict, ...] = ()
    annotations: tuple[dict, ...] = field(default=())

    def windows(self, condition: str | None = None) -> DataFrame:
        """ord, condition, t_start_s, t_end_s, derived_from, status, in the order of the manifest."""
        rows = _own(self.tables["windows"], self.study_id, self.session).withColumn("ord", F.monotonically_increasing_id())
        rows = rows.select("ord", "condition", F.col("t_start_s").try_cast("double").alias("t_start_s"), F.col("t_end_s").try_cast("double").alias("t_end_s"), "derived_from", "status")
        return rows if condition is None else rows.where(F.col("condition") == condition)

    def conditions(self) -> list[str]:
        """In order of their first window."""
        first = self.windows().groupBy("condition").agg(F.min("ord").alias("ord"))
        return [r["condition"] for r in first.orderBy("ord").collect()]

    def leads(self) -> list[str]:
        """Leads with a channel that is included."""
        return sorted(r[0] for r in self.contacts.where("available").select("lead").distinct().collect())

    def apply_qc(self, actions: Sequence[Mapping[str, str]]) -> Session:
        """The session after approved actions, and what of them took effect: exclusions drop contacts, the rest is only told."""
        held = {(r["lead"], r["contact"]) for r in self.contacts.where("available").select("lead", "contact").collect()}
        gone, applied, notes = [], [], []
        for a in actions:
            lead, _, contact = a.get("target", "").partition(":")
            if a.get("action") == "exclude_channel" and (lead, contact) in held:
                gone.append((lead, contact))
                held.discard((lead, contact))
                applied.append({**a, "effect": f"dropped {contact} from {lead}"})
            elif a.get("action") == "annotate_window":
                notes.append(dict(a))
                applied.append({**a, "effect": "annotated, samples kept"})
            elif a.get("action") == "notch":
                applied.append({**a, "effect": "recommended, not applied"})
        contacts = self.contacts
        if gone:
            dropped = contacts.sparkSession.createDataFrame(gone, "lead string, contact string").withColumn("_gone", F.lit(True))
            contacts = contacts.join(dropped, ["lead", "contact"], "left").withColumn("available", F.col("available") & F.col("_gone").isNull()).drop("_gone")
        return replace(self, contacts=contacts, applied=tuple(applied), annotations=tuple(notes))

    def derived(self, chunks: DataFrame, lead: str, scheme: str, rate: float, target: float | None = None, width: int = 1 << 14) -> Derived:
        """A lead's signals under a montage: chunks (stream, channel, t0_idx, x) weighted and added on a common grid.

        Decimation comes after, so its filter acts on what is analysed.
        """
        own = self.contacts.where(F.col("lead") == lead)
        weights = catalog.montage_weights(own, scheme)
        named = weights.join(own.select("contact", "stream", "channel"), "contact").select("derivation", "stream", "channel", "w")
        windows = grid.grid_windows(chunks, ["stream", "channel"], width).join(named, ["stream", "channel"])
        zero = F.transform(F.get("parts", F.lit(0))["x"], lambda _: F.lit(0.0))
        total = F.aggregate("parts", zero, lambda s, p: F.zip_with(s, p["x"], lambda u, v: u + p["w"] * v))
        members = named.groupBy("derivation").agg(F.count(F.lit(1)).alias("_members"))
        # The contacts of a derivation, a handful; one that lacks a window leaves the derivation without it.
        added = windows.groupBy("derivation", "k").agg(F.collect_list(F.struct("w", "x")).alias("parts"), F.min("first").alias("t0_idx")).join(members, "derivation")
        whole = (F.size("parts") == F.col("_members")) & ~F.exists("parts", lambda p: p["x"].isNull())
        signal = added.select("derivation", "t0_idx", F.when(whole, total).alias("x"))
        factor = 1
        if target:
            factor = max(1, int(rate // target)) if 0 < target < rate else 1
            if factor > 1:
                signal = grid.decimate(signal.where("x is not null"), ["derivation"], stages(factor), width)
        share = formulas.cutoff_share(self.configs.get("guardrails"))
        return Derived(lead, scheme, signal, self.derivation_rows(lead, scheme), catalog.montage_notes(own, scheme), rate / factor, factor, rate / factor / 2 * share)

    def derivation_rows(self, lead: str, scheme: str) -> DataFrame:
        """derivation, row_label: that of its leading contact, else unknown."""
        own = self.contacts.where(F.col("lead") == lead)
        names = catalog.montage_weights(own, scheme).select("derivation").distinct().withColumn("contact", F.substring_index("derivation", "-", 1))
        return names.join(own.select("contact", "row_label"), "contact", "left").select("derivation", F.coalesce("row_label", F.lit("unknown")).alias("row_label"))

    def epochs(self, signal: DataFrame, rate: float, epoch_s: float, overlap: float = 0.0, conditions: Sequence[str] | None = None) -> DataFrame:
        """trial, condition, derivation, window, x: the windows of the conditions in epochs; one too short stays whole."""
        rows = self.windows().where(F.col("t_end_s") > F.col("t_start_s"))
        if conditions is not None:
            rows = rows.where(F.col("condition").isin(list(conditions)))
        cut = epoch_bounds(rows.withColumnsRenamed({"t_start_s": "t0", "t_end_s": "t1"}), epoch_s, overlap)
        names = sorted(r[0] for r in signal.select("derivation").distinct().collect())  # one lead's, a handful
        starts = cut.withColumn("derivation", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
        place = Window.partitionBy("derivation").orderBy("ord", "a")
        starts = starts.withColumn("trial", F.row_number().over(place) - 1).select(
            "derivation", F.concat_ws("/", "derivation", "trial").alias("id"), F.col("trial").cast("long").alias("trial"), "condition", F.col("ord").alias("window"),
            F.round(F.col("a") * rate).cast("long").alias("first"), F.round(F.col("b") * rate).cast("long").alias("last"),
        )
        return events.cut_at(signal, ["derivation"], starts).where("x is not null").select("trial", "condition", "derivation", "window", "x")

    def facts(self, scheme: str, bandwidth_hz: float, bands: Mapping[str, Sequence[float]], conditions: Sequence[str] | None = None, window_s: float | None = None, event_s: float | None = None, **more) -> dict:
        """What the guardrails see of an analysis: computed from the tables, not asserted."""
        chosen = list(conditions) if conditions is not None else self.conditions()
        rows = self.windows().where(F.col("condition").isin(chosen)).select("condition", "derived_from", "status").distinct().collect()
        private = self.configs.get("privacy") or {}
        safe = privacy.filenames_deidentified(private, self.format)
        return {
            "scheme": scheme, "shared_reference": True, "bandwidth_hz": float(bandwidth_hz), "bands": [(n, float(a), float(b)) for n, (a, b) in bands.items()], "conditions": chosen,
            "window_s": window_s, "event_s": event_s, "windows": sorted(tuple(r) for r in rows), "emg_regressed": False,
            "paths": [self.path] if safe and self.path and not self.path.startswith("/") and "://" not in self.path else [], "deidentified": safe, **more,
        }


@dataclass(frozen=True)
class Derived:
    """A lead's signals under a montage: chunks by derivation, their rows, what was left out, and what the rate supports."""

    lead: str
    scheme: str
    signal: DataFrame
    rows: DataFrame
    notes: DataFrame
    rate: float
    factor: int
    bandwidth_hz: float


def stages(factor: int, most: int = formulas.MOST_PER_STAGE) -> list[int]:
    """A factor as a product of stages, one if it is small enough; a large prime stays whole."""
    if factor <= most:
        return [factor]
    done = []
    for d in range(most, 1, -1):
        while factor > most and factor % d == 0:
            done.append(d)
            factor //= d
    return done + ([factor] if factor > 1 else [])


def excursion(values: Sequence[float]) -> float | None:
    """Peak to peak of a series smoothed over a fifth of its length, at least three; None below five values."""
    n = len(values)
    if n < 5:
        return None
    width = max(3, n // 5)
    smooth = [sum(values[i : i + width]) / width for i in range(n - width + 1)]
    return max(smooth) - min(smooth)


def _own(rows: DataFrame, study_id: str, session: str) -> DataFrame:
    return rows.where((F.col("study_id") == study_id) & (F.col("session") == session)).drop("study_id", "session")


def row_labels(model: DataFrame) -> DataFrame:
    """model's contacts with row_label: ventral, mid and dorsal rings; lower, mid and upper segments, by rank among rows of their kind."""
    kinds = Window.partitionBy("lead_model", "kind")
    rank = F.dense_rank().over(kinds.orderBy("row"))
    last = F.max(rank_ := F.col("_rank")).over(kinds)
    ranked = model.withColumn("_rank", rank).withColumn("_last", last)
    ring = F.col("kind") == "ring"
    label = (
        F.when(rank_ == 1, F.when(ring, "ventral_ring").otherwise("lower_segments"))
        .when(rank_ == F.col("_last"), F.when(ring, "dorsal_ring").otherwise("upper_segments"))
        .otherwise(F.concat(F.lit("mid_"), F.when(ring, "ring").otherwise("segments"), F.lit("_"), (rank_ - 1).cast("string")))
    )
    return ranked.withColumn("row_label", label).drop("_rank", "_last")


def model_table(spark: SparkSession, leads: Mapping[str, Mapping]) -> DataFrame:
    """lead_model, contact, row, pos, kind of a configuration of lead models."""
    rows = [(m, str(c["id"]), int(c["row"]), i, c.get("kind", "ring")) for m, spec in leads.items() for i, c in enumerate(spec.get("contacts", []))]
    return spark.createDataFrame(rows, "lead_model string, contact string, row int, pos int, kind string")


def open_session(spark: SparkSession, tables: Mapping[str, DataFrame], configs: Mapping[str, Mapping], study_id: str, session: str) -> Session:
    """The session that the manifest names; nothing is guessed. Channels count if they are included."""
    subject = _own(tables["subjects"], study_id, session).first()
    if subject is None:
        raise KeyError(f"the manifest has no subject {study_id} / {session}")
    models = (configs.get("leads") or {}).get("leads") or {}
    leads = _own(tables["leads"], study_id, session).select(F.col("lead_id").alias("lead"), "lead_model")
    used = [r["lead_model"] for r in leads.select("lead_model").distinct().collect()]
    if unknown := sorted(set(used) - set(models)):
        raise KeyError(f"lead models that no configuration defines: {', '.join(unknown)}")
    channels = manifest.included(_own(tables["channels"], study_id, session)).select(
        F.col("lead_id").alias("lead"), F.col("lead_contact").alias("contact"), "stream", F.col("ch_index").try_cast("int").alias("ch"), F.col("ch_name").alias("channel")
    )
    every = leads.join(row_labels(model_table(spark, {m: models[m] for m in used})), "lead_model")
    contacts = every.join(channels, ["lead", "contact"], "left").withColumn("available", F.col("ch").isNotNull())
    return Session(study_id, session, subject["format"], subject["root_relpath"], tables, configs, contacts)


def usable_bandwidth(rate: float, configs: Mapping[str, Mapping]) -> float:
    return rate / 2 * formulas.cutoff_share(configs.get("guardrails"))
