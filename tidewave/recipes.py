"""Recipes: named analyses that are gated, checked before they run, and recorded after.

A recipe is a function (spark, sf_dir, params) -> DataFrame with declared parameters.
run() goes in this order: parameters are validated; the study's review must be approved
where a gate is given; the guardrails see the facts that the recipe states about the
plan; only then a record is opened, the result is computed and written, and the facts
that only the result can tell are checked, which no longer blocks. A refusal leaves
nothing behind; a failure leaves a record that says so.
"""

from __future__ import annotations

import hashlib
import json
import re
import traceback
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import formulas, guardrails, kernels, review, spectral, stats
from tidewave.plans import registry
from tidewave.plans.spectral import FS
from tidewave.plans.tables import epochs


@dataclass(frozen=True)
class Param:
    """A parameter: its default (whose type it has), bounds or choices, and how a form shows it."""

    default: object
    label: str = ""
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    essential: bool = False

    def read(self, name: str, value: object) -> object:
        kind = type(self.default)
        if isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind):
            raise ValueError(f"{name} must be {kind.__name__}, not {value!r}")
        value = kind(value)
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} must lie between {self.low} and {self.high}, not at {value}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.choices))}, not {value}")
        return value

    def schema(self, name: str) -> dict:
        kind = {bool: "boolean", int: "integer", float: "number", str: "string"}[type(self.default)]
        out = {"type": kind, "default": self.default, "title": self.label or name, "x-group": "essential" if self.essential else "advanced"}
        return out | {k: v for k, v in (("minimum", self.low), ("maximum", self.high), ("enum", list(self.choices) or None)) if v is not None}


Build = Callable[[SparkSession, str, Mapping[str, object]], DataFrame]


@dataclass(frozen=True)
class Recipe:
    """facts: what the parameters say about the plan; facts_after: what the result says."""

    name: str
    question: str
    produces: str
    version: str
    params: Mapping[str, Param]
    build: Build
    facts: Callable[[Mapping], Mapping] = lambda params: {}
    facts_after: Callable[[Mapping, DataFrame], Mapping] | None = None

    def validated(self, given: Mapping | None) -> dict:
        unknown = sorted(set(given or {}) - set(self.params))
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(unknown)}; it has {', '.join(self.params)}")
        return {name: p.read(name, (given or {}).get(name, p.default)) for name, p in self.params.items()}

    def schema(self) -> dict:
        return {"type": "object", "properties": {n: p.schema(n) for n, p in self.params.items()}}


RECIPES: dict[str, Recipe] = {}


def recipe(name: str, question: str, produces: str = "", version: str = "1", facts=None, facts_after=None, **params: Param):
    """Register a recipe; a name can be taken once."""

    def add(build: Build) -> Build:
        if name in RECIPES:
            raise ValueError(f"recipe {name} is there already")
        RECIPES[name] = Recipe(name, question, produces, version, params, build, facts or (lambda p: {}), facts_after)
        return build

    return add


def describe_all() -> list[dict]:
    """What a form needs: name, question, product, version and parameters of every recipe."""
    return [
        {"name": r.name, "question": r.question, "produces": r.produces, "version": r.version, "params_schema": r.schema()}
        for r in (RECIPES[n] for n in sorted(RECIPES))
    ]


#: What the epochs' rate supports after an anti-alias filter.
USABLE = formulas.CUTOFF_SHARE * FS / 2
_WINDOW = {
    "samples": Param(64, "Samples per segment", 8, essential=True), "overlap": Param(0.5, "Overlap of segments", 0.0, 0.95),
    "fmin": Param(1.0, "Lowest frequency (Hz)", 0.0), "fmax": Param(USABLE, "Highest frequency (Hz)", 0.0, essential=True),
}


def _spectra(spark, sf_dir, p):
    return spectral.spectrum(epochs(spark, sf_dir), FS, p["samples"], p["overlap"], p["fmin"], p["fmax"])


def _spectral_facts(p: Mapping) -> dict:
    bands = [("requested", float(p["fmin"]), float(p["fmax"]))]
    return {"bands": bands, "bandwidth_hz": USABLE, "window_s": p["samples"] / FS, "reports_db": True, "reports_z": True, "baseline_smoothed": False}


@recipe("psd_by_condition", "Which frequencies are stronger in one condition than another?", "mean, spread and z of decibels by condition and bin", facts=_spectral_facts, **_WINDOW)
def _psd(spark, sf_dir, p):
    return spectral.add_z(spectral.spectrum_by_condition(_spectra(spark, sf_dir, p).where("k is not null")))


def _largest_effect(p: Mapping, out: DataFrame) -> dict:
    return {"effect_db": out.agg(F.max(F.abs("effect"))).first()[0]}


@recipe(
    "bandpower_contrast", "Which bands change between conditions?", "effect, permutation p and bootstrap interval of every band and pair",
    facts=_spectral_facts, facts_after=_largest_effect, **_WINDOW,
    draws=Param(5000, "Permutations", 100), boots=Param(2000, "Bootstrap samples", 100), least=Param(5, "Fewest trials of a condition", 2, essential=True), top=Param(8, "Effects reported", 1),
)
def _contrast(spark, sf_dir, p):
    power = spectral.band_power(_spectra(spark, sf_dir, p).where("power is not null")).where("power > 0")
    db = power.select("trial", "condition", "band", (10 * F.log10("power")).alias("value"))
    return stats.tested_contrast(db, "band", p["draws"], p["boots"], p["least"]).orderBy(F.abs("effect").desc(), "band", "a", "b").limit(p["top"])


@recipe(
    "tfr_morlet", "When and at which frequency does power change?", "power over its baseline by condition, frequency and time",
    facts=lambda p: {"bands": [("requested", p["fmin"], p["fmax"])], "bandwidth_hz": USABLE, "baseline_smoothed": False},
    fmin=Param(2.0, "Lowest frequency (Hz)", 0.5), fmax=Param(USABLE, "Highest frequency (Hz)", 1.0), count=Param(40, "Frequencies", 2), cycles=Param(4.0, "Cycles per wavelet", 1.0), step=Param(4, "Keep every n-th sample", 1),
    base_from=Param(0.0, "Baseline from (s)"), base_to=Param(0.1, "Baseline to (s)", essential=True),
)
def _tfr(spark, sf_dir, p):
    ratio = (p["fmax"] / p["fmin"]) ** (1 / (p["count"] - 1))
    freqs = [p["fmin"] * ratio**i for i in range(p["count"])]
    return kernels.baseline_log_ratio(kernels.time_frequency(epochs(spark, sf_dir), FS, freqs, p["cycles"], p["step"]), p["base_from"], p["base_to"])


@recipe("pac_tort", "Does slow phase carry fast amplitude?", "modulation index by condition and pair of bands", bins=Param(18, "Phase bins", 6))
def _pac(spark, sf_dir, p):
    out = kernels.comodulation(epochs(spark, sf_dir), FS, [(4.0, 8.0), (8.0, 12.0)], [(20.0, 30.0), (30.0, 50.0)], p["bins"])
    return out.groupBy("condition", "slow", "fast").agg(F.avg("mi").alias("mi"), F.count("mi").alias("n"))


@recipe(
    "ringing_measures", "How does an evoked oscillation decay?", "frequency, amplitude and decay of every trial",
    low=Param(10.0, "Lowest frequency (Hz)", 0.5), high=Param(50.0, "Highest frequency (Hz)", 1.0, FS / 2), fraction=Param(0.2, "Least prominence", 0.0, 1.0), tolerance=Param(0.3, "Tolerance of the spacing", 0.0, 1.0),
)
def _ringing(spark, sf_dir, p):
    return kernels.ringing(epochs(spark, sf_dir), FS, p["low"], p["high"], p["fraction"], p["tolerance"])


@recipe("phase_locking", "Is phase consistent over trials?", "locking value and consistency by condition and bin", **_WINDOW)
def _locking(spark, sf_dir, p):
    return spectral.phase_locking(spectral.phases(_spectra(spark, sf_dir, p).where("k is not null")), ["condition", "k"])


@recipe("erp_average", "What follows an event on average?", "mean and spread of the trials by condition and time")
def _erp(spark, sf_dir, p):
    return registry.QUERIES["erp_average"](spark, sf_dir)


@dataclass
class Run:
    run_id: str
    recipe: str
    version: str
    claim: str
    params: dict
    user: str = "unknown"
    status: str = "running"
    error: str | None = None
    started_at: str = ""
    finished_at: str = ""
    inputs: list = field(default_factory=list)
    outputs: list = field(default_factory=list)
    findings: list = field(default_factory=list)
    overrides: dict = field(default_factory=dict)
    review: dict = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    config_sha256: str = ""
    versions: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


class Blocked(Exception):
    """A rule blocks the run; nothing was computed."""

    def __init__(self, findings: list[dict]):
        self.findings = findings
        told = [f"{f['rule']}: {guardrails.RULES[f['rule']].says}; {guardrails.RULES[f['rule']].remedy}" for f in findings if f["blocks"]]
        super().__init__("nothing was computed. " + " | ".join(told))


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def make_run_id(name: str, now: datetime, taken: set[str] = frozenset()) -> str:
    base = f"{now:%Y%m%d_%H%M%S}_{re.sub('[^A-Za-z0-9_-]', '_', name)}"
    return next(x for x in (base if not i else f"{base}-{i + 1}" for i in range(len(taken) + 1)) if x not in taken)


def redact_paths(text: str | None) -> str | None:
    """Absolute paths become <path>, so that a record names no file system."""
    if not text:
        return text
    quoted = re.sub(r"([\"'])(?:/|[A-Za-z]:\\|file:)[^\"'\n]*\1", r"\1<path>\1", text)
    return re.sub(r"(?<![\w<])(?:file:)?/(?:[\w.@~+-]+/)+[\w.@~+-]*", "<path>", quoted)


# --- the store: a folder of runs, written and read by Spark ---------------------------

_INDEX = "run_id string, recipe string, status string, claim string, user string, started_at string, finished_at string, config_sha256 string, record string"


def _write_record(spark: SparkSession, store: str, run: Run) -> None:
    row = (run.run_id, run.recipe, run.status, run.claim, run.user, run.started_at, run.finished_at, run.config_sha256, run.to_json())
    spark.createDataFrame([row], _INDEX).coalesce(1).write.mode("append").json(f"{store}/records")


def list_runs(spark: SparkSession, store: str, name: str | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """The last record of every run, newest first; none if the store is empty. name, status: only such runs; limit: the newest so many."""
    try:
        rows = spark.read.schema(_INDEX).json(f"{store}/records")
    except AnalysisException:
        return spark.createDataFrame([], _INDEX)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns), F.struct("finished_at", "status")).alias("r")).select("r.*")
    for column, wanted in (("recipe", name), ("status", status)):
        last = last if wanted is None else last.where(F.col(column) == wanted)
    ordered = last.orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def reindex(spark: SparkSession, store: str, into: str) -> int:
    """The index columns of every record derived anew from the record itself, written to another store; records that can't be read are left out."""
    rows = spark.read.schema(_INDEX).json(f"{store}/records").select("record")
    names = [f.split()[0] for f in _INDEX.split(", ")][:-1]
    parsed = rows.select(F.from_json("record", ", ".join(f"{n} string" for n in names)).alias("r"), "record").where("r.run_id is not null")
    parsed.select(*[F.col(f"r.{n}").alias(n) for n in names], "record").write.mode("overwrite").json(f"{into}/records")
    return list_runs(spark, into).count()


def redact_exception(error: BaseException) -> tuple[str, str]:
    """The class of an error, and its message with that of its causes and members, without paths. No traceback."""
    seen: set[int] = set()

    def told(e: BaseException) -> str:
        if id(e) in seen:
            return "again"
        seen.add(id(e))
        parts = [str(e)]
        if isinstance(e, BaseExceptionGroup):
            parts += [f"{type(x).__name__}: {told(x)}" for x in e.exceptions]
        if e.__cause__ is not None:
            parts.append(f"caused by {type(e.__cause__).__name__}: {told(e.__cause__)}")
        return "; ".join(parts)

    return type(error).__name__, redact_paths(told(error)) or ""


def get_run(spark: SparkSession, store: str, run_id: str) -> dict:
    found = list_runs(spark, store).where(F.col("run_id") == run_id).first()
    if found is None:
        raise KeyError(f"no run {run_id}")
    return json.loads(found["record"])


def add_input(run: Run, table: DataFrame, key: Mapping[str, str]) -> None:
    """Name an input by its key, its rows and a hash of them that doesn't depend on their order."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)")
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashed), F.lit(0))).first()
    run.inputs.append({"key": dict(key), "rows": n, "hash": str(total)})


def check(spark: SparkSession, facts: Mapping, overrides: Mapping[str, str] | None, config: Mapping | None) -> list[dict]:
    """The rules that fire on one plan."""
    names = [f.split()[0] for f in guardrails.FACTS.split(", ")]
    unknown = sorted(set(facts) - set(names))
    if unknown:
        raise ValueError(f"no such fact: {', '.join(unknown)}")
    plan = spark.createDataFrame([tuple({"plan": "run", **facts}.get(n) for n in names)], guardrails.FACTS)
    return [r.asDict() for r in guardrails.run_checks(plan, overrides, config).orderBy("rule").collect()]


def run(
    spark: SparkSession, sf_dir: str, name: str, claim: str, params: Mapping | None = None, facts: Mapping | None = None,
    overrides: Mapping[str, str] | None = None, config: Mapping | None = None, store: str | None = None, user: str = "unknown",
    study: str | None = None, states: DataFrame | None = None,
) -> tuple[Run, DataFrame]:
    """The record and the result of a recipe. Raises if the gate is shut or a rule blocks.

    facts: more that is known of the plan, as ``Session.facts`` states it. config: settings of the guardrails. store: the
    folder that takes the record and the result; without one both are only returned. study
    and states (as of review.status): the gate.
    """
    if not claim.strip():
        raise ValueError("a run needs a claim")
    if name not in RECIPES:
        raise KeyError(f"unknown recipe {name}; there are {', '.join(sorted(RECIPES))}")
    spec = RECIPES[name]
    chosen = spec.validated(params)
    if states is not None:
        review.require_approved(states, study)
    told = {**spec.facts(chosen), **(facts or {})}
    findings = check(spark, told, overrides, config)
    if any(f["blocks"] for f in findings):
        raise Blocked(findings)

    stamp = lambda: datetime.now(timezone.utc).isoformat(timespec="microseconds")
    taken = {r["run_id"] for r in list_runs(spark, store).select("run_id").collect()} if store else set()
    snapshot = {"recipe": {"name": name, "version": spec.version}, "params": chosen, "guardrails": {k: dict(v) for k, v in (config or {}).items()}}
    record = Run(
        make_run_id(name, datetime.now(timezone.utc), taken), name, spec.version, claim.strip(), chosen, user, started_at=stamp(), findings=findings,
        overrides=dict(overrides or {}), review={"study": study, "enforced": states is not None}, config=snapshot,
        config_sha256=config_hash(snapshot), versions={"pyspark": pyspark.__version__},
    )
    try:
        add_input(record, epochs(spark, sf_dir), {"table": "epochs"})
        out = spec.build(spark, sf_dir, chosen)
        if store:
            path = f"{store}/results/{record.run_id}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            record.outputs.append(f"results/{record.run_id}")
            record.summary = {"rows": out.count(), "columns": out.columns}
        if spec.facts_after:
            # Too late to refuse: the result is there, so these are reported.
            later = check(spark, {**told, **spec.facts_after(chosen, out)}, overrides, config)
            record.findings += [{**f, "after": True} for f in later if f["rule"] not in {x["rule"] for x in findings}]
        record.status = "ok"
        return record, out
    except Exception:
        record.status, record.error = "failed", redact_paths(traceback.format_exc(limit=5))
        raise
    finally:
        record.finished_at = stamp()
        if store:
            _write_record(spark, store, record)

