"""What a configuration must hold before anything is run by it, as tables of constraints.

A constraint speaks of the places a path leads to ("*" stands for every key there) and of
what may stand there. One checker reads all tables and reports every fault at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from tidewave.operators import guardrails, normalize

_ABSENT = object()


class ConfigError(ValueError):
    """Faults of a configuration: ``faults`` lists (path, what is wrong)."""

    def __init__(self, faults: list[tuple[str, str]]):
        self.faults = faults
        super().__init__("; ".join(f"{path or 'the configuration'} {what}" for path, what in faults))


@dataclass(frozen=True)
class Constraint:
    """kind: mapping, text, number, whole, edges (two rising numbers) or any.

    keys: names that a mapping must have. among: allowed values, or the path of a mapping
    whose keys are allowed. least (a value above, if ``beyond``). rises_to: the path of a
    number that must be larger. absent: a place may be empty. when: holds only if that
    path's value is true.
    """

    path: str
    kind: str = "any"
    keys: tuple[str, ...] = ()
    among: tuple | str | None = None
    least: float | None = None
    beyond: bool = False
    rises_to: str | None = None
    absent: bool = False
    when: str | None = None


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


KINDS = {
    "mapping": (lambda v: isinstance(v, Mapping) and len(v) > 0, "a mapping with entries"),
    "text": (lambda v: isinstance(v, str) and v.strip() != "", "text that people can read"),
    "number": (_is_number, "a number"),
    "whole": (lambda v: _is_number(v) and v == int(v), "a whole number"),
    "edges": (lambda v: isinstance(v, (list, tuple)) and len(v) == 2 and all(map(_is_number, v)) and v[0] < v[1], "two rising numbers"),
    "any": (lambda v: True, "anything"),
}


def _texts(prefix: str, *names: str) -> tuple[Constraint, ...]:
    return tuple(Constraint(f"{prefix}.{n}", "text") for n in names)


#: Key names are fixed values: configurations are written with them.
TABLES: dict[str, tuple[Constraint, ...]] = {
    "bands": (Constraint("bands", "mapping"), Constraint("bands.*", "edges", least=0, beyond=True)),
    "guardrails": (
        Constraint("guardrails", "mapping", keys=tuple(sorted(guardrails.CHECKS))),
        Constraint("guardrails.*", "mapping"),
        Constraint("guardrails.*.severity", among=guardrails.SEVERITIES, absent=True),
    ),
    "qc_thresholds": (
        Constraint("actions", "mapping", keys=("none",)),
        *_texts("actions.*", "label", "description"),
        Constraint("detectors", "mapping"),
        *_texts("detectors.*", "label", "means"),
        Constraint("detectors.*.proposed_action", among="actions"),
        Constraint("detectors.*.severity", among=("low", "med", "high")),
    ),
    "statistics": (
        Constraint("centers", "mapping", keys=tuple(normalize.CENTERS)),
        Constraint("scales", "mapping", keys=tuple(normalize.SCALES)),
        *(c for group in ("centers", "scales") for c in _texts(f"{group}.*", "label", "description", "when_to_use", "caveat")),
    ),
    "erna": (
        Constraint("band.low_hz", "number", rises_to="band.high_hz"),
        Constraint("band.high_hz", "number"),
        Constraint("window.analysis_ms", "number", least=0, beyond=True),
        Constraint("window.blanking_ms", "number", least=0),
        Constraint("peaks.min_peaks", "whole", least=2),
        Constraint("peaks.prominence", "number"),
        Constraint("stim.source", among=("amplitude_threshold", "windows", "epochs")),
        Constraint("reviewed_by", "text", when="defaults_reviewed"),
    ),
}


def _places(node: object, steps: list[str], done: tuple[str, ...] = ()) -> Iterator[tuple[str, object]]:
    """Where a path leads, with what is there; a dead end leads to nothing, once."""
    if not steps:
        yield ".".join(done), node
    elif steps[0] == "*":
        for key, value in node.items() if isinstance(node, Mapping) else ():
            yield from _places(value, steps[1:], (*done, str(key)))
    elif isinstance(node, Mapping) and steps[0] in node:
        yield from _places(node[steps[0]], steps[1:], (*done, steps[0]))
    else:
        yield ".".join((*done, *steps)), _ABSENT


def _at(config: Mapping, path: str) -> object:
    return next((value for _, value in _places(config, path.split("."))), _ABSENT)


def _wrong(config: Mapping, c: Constraint, value: object) -> str | None:
    """What is wrong with a value, in a word or two."""
    fits, name = KINDS[c.kind]
    if value is _ABSENT:
        return None if c.absent else "is missing"
    if not fits(value):
        return f"must be {name}"
    if lost := [k for k in c.keys if k not in value]:
        return f"lacks {', '.join(lost)}"
    if c.among is not None:
        allowed = tuple(_at(config, c.among)) if isinstance(c.among, str) and isinstance(_at(config, c.among), Mapping) else () if isinstance(c.among, str) else c.among
        if value not in allowed:
            return f"must be one of {', '.join(map(str, allowed))}"
    if c.least is not None:
        lowest = value[0] if c.kind == "edges" else value
        if lowest < c.least or c.beyond and lowest == c.least:
            return f"must be {'above' if c.beyond else 'at least'} {c.least:g}"
    if c.rises_to is not None:
        top = _at(config, c.rises_to)
        if _is_number(top) and value >= top:
            return f"must be below {c.rises_to}"
    return None


def faults(config: object, table: tuple[Constraint, ...]) -> list[tuple[str, str]]:
    """Every (path, what is wrong) of a configuration under a table of constraints."""
    if not isinstance(config, Mapping):
        return [("", "must be a mapping")]
    found = []
    for c in table:
        if c.when is None or _at(config, c.when) not in (_ABSENT, None, False, ""):
            found += [(path, what) for path, value in _places(config, c.path.split(".")) if (what := _wrong(config, c, value))]
    return found


def validate(name: str, config: object) -> Mapping:
    """The configuration, if nothing is wrong with it; one without a table need only be a mapping."""
    if wrong := faults(config, TABLES.get(name, ())):
        raise ConfigError(wrong)
    return config


def extent_of(spec: object, default: str = "until_next") -> tuple[str, float | None]:
    """How far an annotation's window reaches: until_next, annotation, or a fixed number of seconds; the default for anything else."""
    if isinstance(spec, Mapping) and "fixed_s" in spec:
        return "fixed_s", float(spec["fixed_s"])
    return (spec, None) if spec in ("until_next", "annotation") else (default, None)
