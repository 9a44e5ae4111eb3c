"""What may leave a site: a policy per format, and a walk through nested values that finds what must not.

The walk follows a column's type: structs by field, maps by key and value, arrays by
element. It is one expression per leaf, so rows are judged where they are, and gives the rule
that fired and where, never the text itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
#: What no configuration can allow, as Java patterns by rule.
FLOOR = {
    "absolute path": r"""(?:^|[\s"'=(\[,;])(?:~?/[^\s/"']+/[^\s"']*|~[/\\]|[A-Za-z]:[\\/][^\s"']+|\\\\[^\s"']+)|^\s*(?:/|[A-Za-z]:[\\/])""",
    "uri": r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]*://",
    "compact date": r"(?<![A-Za-z0-9])(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?![A-Za-z0-9])",
    "dashed date": r"(?<!\d)(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])(?!\d)",
    "month-name date": rf"(?i)(?<![A-Za-z0-9])(?:\d{{1,2}}(?:st|nd|rd|th)?[\s\-./]+{_MONTH}|{_MONTH}[\s\-./]+\d{{1,2}}(?!\d))",
}
#: Numbers this large under such a key are stamps; these keys are offsets.
STAMP_KEY, STAMP_FREE, STAMP_SIZE = r"(?i)date|time|stamp|epoch_s|meas_", ("t0_s", "time_origin"), 1e6


class PrivacyRefusal(ValueError):
    """Something that must not leave was about to be written."""


@dataclass(frozen=True)
class Policy:
    """What a site takes for safe; the default is the careful one."""

    filenames_deidentified: bool = False
    restricted_fields: frozenset[str] = frozenset()

    @classmethod
    def of(cls, config: Mapping, format: str) -> Policy:
        restricted = (config.get("restricted_metadata_fields") or {}).get(format) or ()
        return cls(filenames_deidentified(config, format), frozenset(restricted))


def filenames_deidentified(config: Mapping, format: str) -> bool:
    """One answer for all formats, or one each; a format that isn't named is not deidentified."""
    answer = config.get("filenames_deidentified", False)
    return bool(answer.get(format, False)) if isinstance(answer, Mapping) else bool(answer)


def shown_metadata(rows: DataFrame, policy: Policy, metadata: str = "metadata", path: str = "path") -> DataFrame:
    """rows with metadata without restricted fields, the names of those that were there, and the file's name if it may be seen."""
    hidden = F.array(*[F.lit(f) for f in sorted(policy.restricted_fields)]).cast("array<string>")
    present = F.array_sort(F.filter(F.map_keys(metadata), lambda k: F.array_contains(hidden, k)))
    shown = F.map_filter(metadata, lambda k, _: ~F.array_contains(hidden, k))
    name = F.element_at(F.split(path, r"[/\\]"), -1) if policy.filenames_deidentified else F.lit(None).cast("string")
    return rows.withColumns({"restricted_fields_present": present, metadata: shown, "path_name": name}).drop(path)


def rules(patterns: Mapping[str, str] | None = None) -> dict[str, str]:
    """The configured patterns, then those that hold whatever the configuration says."""
    return {**(patterns or {}), **FLOOR}


def text_violations(text: Column, patterns: Mapping[str, str]) -> Column:
    """The rules that a text breaks, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda r: r.isNotNull())


_FOUND = "array<struct<where:string,rule:string>>"


def _at(where: Column, names: Column) -> Column:
    return F.transform(names, lambda r: F.struct(where.alias("where"), r.alias("rule")))


def violations(value: Column, kind: T.DataType, where: Column, patterns: Mapping[str, str], key: Column | None = None) -> Column:
    """(where, rule) of everything in a value of this type that must not leave; keys and field names count as texts."""
    none = F.array().cast(_FOUND)

    def safe(found: Column) -> Column:
        return F.coalesce(found.cast(_FOUND), none)

    if isinstance(kind, T.StringType):
        return safe(_at(where, text_violations(value, patterns)))
    if isinstance(kind, T.BinaryType):
        return safe(_at(where, text_violations(value.cast("string"), patterns)))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(value.isNotNull(), F.array(F.struct(where.alias("where"), F.lit("date or time").alias("rule")))).otherwise(none).cast(_FOUND)
    if isinstance(kind, T.NumericType):
        if key is None:
            return none
        stamp = key.rlike(STAMP_KEY) & ~key.isin(*STAMP_FREE) & (F.abs(value) >= STAMP_SIZE)
        return F.when(stamp, F.array(F.struct(where.alias("where"), F.lit("timestamp").alias("rule")))).otherwise(none).cast(_FOUND)
    if isinstance(kind, T.StructType):
        out = none
        for f in kind.fields:
            name, own = F.lit(f.name), F.concat(where, F.lit("."), F.lit(f.name))
            out = F.concat(out, safe(_at(F.concat(where, F.lit(" key")), text_violations(name, patterns))), violations(value.getField(f.name), f.dataType, own, patterns, name))
        return F.when(value.isNotNull(), out).otherwise(none)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda v: violations(v, kind.elementType, where, patterns, key))
        return F.coalesce(F.array_distinct(F.flatten(each)), none)
    if isinstance(kind, T.MapType):
        keys = F.flatten(F.transform(F.map_keys(value), lambda k: safe(_at(F.concat(where, F.lit(" key")), text_violations(k.cast("string"), patterns)))))
        # A key that must not leave is not told either.
        named = lambda k: F.when(F.size(text_violations(k, patterns)) > 0, F.lit("?")).otherwise(k)
        entries = F.transform(F.map_entries(value), lambda e: violations(e["value"], kind.valueType, F.concat(where, F.lit("."), named(e["key"].cast("string"))), patterns, e["key"].cast("string")))
        return F.concat(F.coalesce(F.array_distinct(keys), none), F.coalesce(F.flatten(entries), none))
    return none


def walk(rows: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] | None = None, allowed: Sequence[str] | None = None) -> DataFrame:
    """rows with ``violations``: (where, rule) of everything in the columns that must not leave.

    allowed: names a struct's or map's top-level keys may have; others are violations too.
    """
    used = rules(patterns)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    found = F.array().cast(_FOUND)
    for c in columns:
        found = F.concat(found, violations(F.col(c), kinds[c], F.lit(c), used, F.lit(c)))
        if allowed is not None:
            list_ = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
            if isinstance(kinds[c], T.MapType):
                names = F.map_keys(F.col(c))
            elif isinstance(kinds[c], T.StructType):
                names = F.array(*[F.lit(n) for n in kinds[c].fieldNames()]).cast("array<string>")
            else:
                continue
            odd = F.filter(names, lambda k: ~F.array_contains(list_, k))  # noqa: B023
            found = F.concat(found, F.coalesce(F.transform(odd, lambda k: F.struct(F.lit(f"{c} key").alias("where"), F.lit("not allowed").alias("rule"))).cast(_FOUND), F.array().cast(_FOUND)))  # noqa: B023
    return rows.withColumn("violations", found)


def refuse(rows: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] | None = None, allowed: Sequence[str] | None = None) -> DataFrame:
    """The rows as they are, if nothing in them must stay; else a refusal that names places and rules only."""
    judged = walk(rows, columns, patterns, allowed).where(F.size("violations") > 0)
    some = judged.select(F.explode("violations").alias("v")).groupBy("v.where", "v.rule").count().orderBy("where", "rule").limit(20).collect()
    if some:
        raise PrivacyRefusal("; ".join(f"{r['where']}: {r['rule']} ({r['count']} rows)" for r in some))
    return rows
