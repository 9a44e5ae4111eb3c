"""Rules over one plan per row: does the analysis answer what it claims to?

A rule decides whether it fires from the plan's facts; the settings decide how much
that matters and with which thresholds. A null fact (or one the plan doesn't carry)
can't be judged, so the rule doesn't fire. All rules are evaluated in one pass: a
plan gives an array of the rules that fire, which is exploded.

Facts (columns of a plan), all optional:
scheme, shared_reference, contact_baseline, ratio_per_channel, threshold_within,
window_s, event_s, bands array<struct<name,lo,hi>>, bandwidth_hz, conditions
array<string>, reports_db, reports_z, windows array<struct<condition,derived_from,
status>>, baseline_smoothed, emg_regressed, excursion_db, effect_db, paths
array<string>, deidentified.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("block", "warn", "note", "off")

#: Which conditions need which control, and why.
CONTROLS = (
    {"applies_to": ("overt", "inner"), "satisfied_by": ("metro", "move"), "because": "speech is a motor act"},
    {"applies_to": ("move", "imagery"), "satisfied_by": ("rest",), "because": "movement starts from an ongoing state"},
    {"applies_to": ("task",), "satisfied_by": ("rest", "cue"), "because": "a cue evokes a response of its own"},
    {"applies_to": ("dbs_on",), "satisfied_by": ("dbs_off",), "because": "one state alone is no contrast"},
)


@dataclass(frozen=True)
class Rule:
    """closed: arithmetic, not judgment; no setting and no override opens it."""

    severity: str
    says: str
    remedy: str
    closed: bool = False
    settings: Mapping[str, object] = field(default_factory=dict)


#: Severities and thresholds that hold unless a configuration changes them.
RULES: dict[str, Rule] = {
    "g01": Rule("block", "a monopolar montage on a shared reference shows common mode as effect", "use a bipolar montage"),
    "g02": Rule("block", "contacts are compared without their own baseline", "subtract each contact's baseline"),
    "g03": Rule("block", "the ratio is taken after averaging over channels", "take it per channel, then average", closed=True),
    "g04": Rule("warn", "one threshold serves all conditions", "set it within each condition", settings={"required": True}),
    "g05": Rule("warn", "the window is much longer than the event", "shorten the window", settings={"max_ratio": 5.0}),
    "g06": Rule("block", "a band reaches above the usable bandwidth", "decimate less, or drop the band", closed=True),
    "g07": Rule(
        "warn", "a band overlaps muscle activity", "bipolar montage and muscle channels regressed out",
        settings={"conditions": ("overt",), "band_hz": (100.0, 1000.0)},
    ),
    "g08": Rule("note", "decibels without z", "report both", settings={"required": True}),
    "g09": Rule("warn", "the recording drifts as much as the effect", "show that it is stable", settings={"min_ratio": 1.0}),
    "g10": Rule(
        "warn", "a window is assumed or under revision", "derive it again",
        settings={"derived_from": ("assumed",), "status": ("draft", "under_revision")},
    ),
    "g11": Rule("warn", "a control condition is missing", "include it, or state the limitation", settings={"controls": CONTROLS}),
    "g12": Rule("block", "baseline statistics come from smoothed data", "use unsmoothed data", closed=True),
    "g13": Rule("block", "paths would be shown while names identify", "use manifest keys", closed=True),
}

Condition = Callable[[Callable[[str], Column], Mapping[str, object]], Column]
CHECKS: dict[str, Condition] = {}


def register(rule: str, **about):
    """Add a rule's condition, a function (fact, settings) -> boolean column; a name is taken once."""

    def add(condition: Condition) -> Condition:
        if rule in CHECKS:
            raise ValueError(f"rule {rule} is there already")
        if rule not in RULES:
            RULES[rule] = Rule(**({"severity": "warn", "says": rule, "remedy": ""} | about))
        CHECKS[rule] = condition
        return condition

    return add


def _words(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


@register("g01")
def _monopolar(fact, settings):
    # Whether the reference is shared may be unknown: only a plain no clears the montage.
    return (fact("scheme") == "monopolar") & F.coalesce(fact("shared_reference"), F.lit(True))


@register("g02")
def _no_contact_baseline(fact, settings):
    return ~fact("contact_baseline")


@register("g03")
def _ratio_after_average(fact, settings):
    return ~fact("ratio_per_channel")


@register("g04")
def _shared_threshold(fact, settings):
    return F.lit(bool(settings["required"])) & ~fact("threshold_within")


@register("g05")
def _long_window(fact, settings):
    return fact("window_s") / F.nullif(fact("event_s"), F.lit(0.0)) > float(settings["max_ratio"])


@register("g06")
def _band_above_bandwidth(fact, settings):
    return F.exists(fact("bands"), lambda b: b["hi"] > fact("bandwidth_hz"))


@register("g07")
def _muscle(fact, settings):
    low, high = map(float, settings["band_hz"])
    speaks = F.arrays_overlap(fact("conditions"), _words(settings["conditions"]))
    met = F.exists(fact("bands"), lambda b: (b["hi"] > low) & (b["lo"] < high))
    cleared = F.coalesce(fact("scheme").startswith("bipolar") & fact("emg_regressed"), F.lit(False))
    return speaks & met & ~cleared


@register("g08")
def _db_alone(fact, settings):
    return F.lit(bool(settings["required"])) & fact("reports_db") & ~F.coalesce(fact("reports_z"), F.lit(False))


@register("g09")
def _drift(fact, settings):
    return F.abs(fact("excursion_db")) / F.nullif(F.abs(fact("effect_db")), F.lit(0.0)) >= float(settings["min_ratio"])


@register("g10")
def _suspect_windows(fact, settings):
    def odd(w):
        return F.coalesce(w["derived_from"].isin(*settings["derived_from"]), F.lit(False)) | F.coalesce(
            w["status"].isin(*settings["status"]), F.lit(False)
        )

    return F.exists(fact("windows"), odd)


def unmet_controls(conditions: Column, controls=CONTROLS) -> list[Column]:
    """For each rule of controls: does a plan with these conditions need a control it lacks?"""
    return [
        F.arrays_overlap(conditions, _words(c["applies_to"])) & ~F.arrays_overlap(conditions, _words(c["satisfied_by"]))
        for c in controls
        if c.get("applies_to")
    ]


@register("g11")
def _no_control(fact, settings):
    needs = [F.coalesce(x, F.lit(False)) for x in unmet_controls(fact("conditions"), settings["controls"])]
    out = F.lit(False)
    for x in needs:
        out = out | x
    return out


@register("g12")
def _smoothed_baseline(fact, settings):
    return fact("baseline_smoothed")


@register("g13")
def _paths(fact, settings):
    return (F.size(fact("paths")) > 0) & ~F.coalesce(fact("deidentified"), F.lit(False))


def configured(config: Mapping[str, Mapping] | None = None) -> dict[str, tuple[str, bool, dict]]:
    """severity, whether an override resolves it, and settings of every rule that isn't off.

    A configuration may change severities and settings and forbid overrides; it can't
    open a closed rule. A flat pair applies_to, satisfied_by under g11 is one control rule.
    """
    out = {}
    for name in sorted(CHECKS):
        rule, own = RULES[name], dict((config or {}).get(name, {}))
        severity = own.pop("severity", rule.severity)
        if severity not in SEVERITIES:
            raise ValueError(f"{name}: unknown severity {severity}")
        allowed = bool(own.pop("allow_override", True)) and not rule.closed
        if name == "g11" and "controls" not in own and "applies_to" in own:
            own = {"controls": [own]}
        if severity != "off":
            out[name] = severity, allowed, {**rule.settings, **own}
    return out


def _evaluated(plans: DataFrame, overrides: Mapping[str, str] | None, config: Mapping[str, Mapping] | None) -> tuple[dict, dict[str, str], Column]:
    """The rules that are on, the reasons given, and an array of the rules that fire on a row."""
    reasons = dict(overrides or {})
    if any(not (reason or "").strip() for reason in reasons.values()):
        raise ValueError("an override needs a reason")
    rules, columns = configured(config), set(plans.columns)

    def fact(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast(_KINDS[name])

    fired = F.array(*[F.when(CHECKS[name](fact, settings), F.lit(name)) for name, (_, _, settings) in rules.items()])
    return rules, reasons, F.array_compact(fired)


def summarize(plans: DataFrame, overrides: Mapping[str, str] | None = None, config: Mapping[str, Mapping] | None = None) -> DataFrame:
    """plan, rules (an array), n_blocking, n_warnings, n_notes of every row, without a row per rule: what blocks, warns and is noted of each plan."""
    rules, reasons, fired = _evaluated(plans, overrides, config)
    blocking = [n for n, (severity, allowed, _) in rules.items() if severity == "block" and not (allowed and n in reasons)]
    of = lambda level: [n for n, (severity, _, _) in rules.items() if severity == level]
    count = lambda r, names: F.size(F.array_intersect(r, _words(names))).cast("long")
    # Generated from one array, so that the conditions are evaluated once however often they are counted.
    told = lambda r: F.struct(r.alias("rules"), count(r, blocking).alias("n_blocking"), count(r, of("warn")).alias("n_warnings"), count(r, of("note")).alias("n_notes"))
    return plans.select("plan", F.inline(F.transform(F.array(fired), told)))


def run_checks(plans: DataFrame, overrides: Mapping[str, str] | None = None, config: Mapping[str, Mapping] | None = None) -> DataFrame:
    """plan, rule, severity, resolved, blocks, reason: the rules that fire.

    overrides: rule to the reason given for going on, which must not be blank. It
    resolves a rule unless the rule is closed or the configuration forbids it.
    """
    rules, reasons, fired = _evaluated(plans, overrides, config)
    each = plans.select("plan", F.explode(fired).alias("rule"))
    told = F.create_map(
        *[
            x
            for name, (severity, allowed, _) in rules.items()
            for x in (
                F.lit(name),
                F.struct(
                    F.lit(severity).alias("severity"), F.lit(allowed and name in reasons).alias("resolved"),
                    F.lit(reasons.get(name)).cast("string").alias("reason"),
                ),
            )
        ]
    )
    about = each.withColumn("t", F.element_at(told, F.col("rule")))
    blocks = (F.col("t.severity") == "block") & ~F.col("t.resolved")
    return about.select("plan", "rule", "t.severity", "t.resolved", blocks.alias("blocks"), "t.reason")


#: The facts a plan may state, and their types.
_KINDS = {
    "scheme": "string", "shared_reference": "boolean", "contact_baseline": "boolean", "ratio_per_channel": "boolean",
    "threshold_within": "boolean", "window_s": "double", "event_s": "double", "bands": "array<struct<name:string,lo:double,hi:double>>",
    "bandwidth_hz": "double", "conditions": "array<string>", "reports_db": "boolean", "reports_z": "boolean",
    "windows": "array<struct<condition:string,derived_from:string,status:string>>", "baseline_smoothed": "boolean",
    "emg_regressed": "boolean", "excursion_db": "double", "effect_db": "double", "paths": "array<string>", "deidentified": "boolean",
}
FACTS = ", ".join(["plan string", *[f"{n} {k}" for n, k in _KINDS.items()]])
