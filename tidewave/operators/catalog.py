"""Constraint queries over the manifest tables: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The spellings of manifest booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def to_bool(value: Column) -> Column:
    """true, false, or null for any other text; case and blanks around don't matter."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def missing_parents(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent (null keys included)."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlapping_windows(windows: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """Windows that begin before an earlier one of their group ends; adjacent ones are fine.

    A window without an end comes after those of its start that have one. ``ties`` orders the windows
    of one start and end, so that reruns agree which of them is the earlier one.
    """
    keys = [F.col(c).asc_nulls_last() for c in ("t0", "t1", *ties)]
    order = W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return windows.withColumn("latest_end", F.max("t1").over(order)).where(F.col("t0") < F.col("latest_end"))


def bad_vocabulary(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*words))


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks; of equal new keys one is taken, the smallest row."""
    fresh = new.join(old.select(*key), key, "left_anti")
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key]))
    return old.unionByName(fresh.withColumn("_r", rank).where("_r = 1").drop("_r"))


def contact_rows(contacts: DataFrame) -> DataFrame:
    """The row label of each contact: its rank among the rows of its kind."""
    rank = F.dense_rank().over(W.partitionBy("lead", "kind").orderBy("row"))
    return contacts.withColumn("row_label", F.concat(F.col("kind"), F.lit("_"), rank.cast("string")))


#: Montages over a lead's geometry; chain is plain neighbours in order.
SCHEMES = ("monopolar", "car", "bipolar_vertical", "bipolar_horizontal", "bipolar_adjacent", "chain")


def _weight(contact: Column, w) -> Column:
    return F.struct(contact.alias("contact"), (F.lit(w) if isinstance(w, float) else w).cast("double").alias("w"))


def _pair(plus: Column, minus: Column) -> list[Column]:
    name = F.concat(plus, F.lit("-"), minus)
    return [name.alias("derivation"), F.array(_weight(plus, 1.0), _weight(minus, -1.0)).alias("members")]


def derivations(contacts: DataFrame, scheme: str) -> DataFrame:
    """lead, derivation, members (contact, w): what a scheme asks for, whether or not all contacts are there.

    contacts: lead, contact, row (from the tip up), pos (order within the row) and available.
    A row of one contact is a ring, others are segments.

    * bipolar_vertical: each segment less the nearest ring (of two, the lower), and the
      highest ring less the lowest;
    * bipolar_horizontal: each segment less the next of its row, the last less the first;
    * bipolar_adjacent: neighbouring rows of one size pairwise, upper less lower; else the ring
      less the mean of the row, if one of them is a ring;
    * car: each available contact less the mean of the available ones.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme}; there are {', '.join(SCHEMES)}")
    order = W.partitionBy("lead").orderBy("row", "pos")
    if scheme == "monopolar":
        return contacts.select("lead", F.col("contact").alias("derivation"), F.array(_weight(F.col("contact"), 1.0)).alias("members"))
    if scheme == "chain":
        pairs = contacts.withColumn("other", F.lead("contact").over(order)).where("other is not null")
        return pairs.select("lead", *_pair(F.col("contact"), F.col("other")))
    if scheme == "car":
        # The contacts of one lead, a handful.
        held = contacts.where("available").withColumn("all", F.collect_list("contact").over(W.partitionBy("lead")))
        w = lambda c: F.when(c == F.col("contact"), 1.0).otherwise(0.0) - 1.0 / F.size("all")
        members = F.transform("all", lambda c: _weight(c, w(c)))
        return held.select("lead", F.concat("contact", F.lit("-car")).alias("derivation"), members.alias("members"))
    sized = contacts.withColumn("in_row", F.count("contact").over(W.partitionBy("lead", "row")))
    segments = sized.where("in_row > 1")
    if scheme == "bipolar_horizontal":
        row = W.partitionBy("lead", "row").orderBy("pos")
        first = F.first("contact").over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        pairs = segments.withColumn("other", F.coalesce(F.lead("contact").over(row), first))
        return pairs.select("lead", *_pair(F.col("contact"), F.col("other")))
    if scheme == "bipolar_vertical":
        rings = sized.where("in_row = 1").select("lead", F.col("contact").alias("ring"), F.col("row").alias("ring_row"))
        near = F.struct(F.abs(F.col("row") - F.col("ring_row")), F.col("ring_row"))
        nearest = segments.join(rings, "lead").groupBy("lead", "contact").agg(F.min_by("ring", near).alias("ring"))
        ends = rings.groupBy("lead").agg(F.max_by("ring", "ring_row").alias("hi"), F.min_by("ring", "ring_row").alias("lo")).where("hi <> lo")
        return nearest.select("lead", *_pair(F.col("contact"), F.col("ring"))).union(ends.select("lead", *_pair(F.col("hi"), F.col("lo"))))
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "contact"))), lambda c: c["contact"])
    rows = contacts.groupBy("lead", "row").agg(own.alias("lower"))
    both = rows.withColumn("upper", F.lead("lower").over(W.partitionBy("lead").orderBy("row"))).where("upper is not null")
    same = both.where(F.size("lower") == F.size("upper")).select("lead", F.explode(F.arrays_zip("lower", "upper")).alias("p"))
    # Rows of unlike sizes have a difference only where one of them is a ring.
    uneven = both.where((F.size("lower") != F.size("upper")) & (F.least(F.size("lower"), F.size("upper")) == 1))
    low = F.size("lower") == 1
    ring, others = F.when(low, F.col("lower")[0]).otherwise(F.col("upper")[0]), F.when(low, F.col("upper")).otherwise(F.col("lower"))
    mean = F.transform(others, lambda c: _weight(c, -1.0 / F.size(others)))
    means = uneven.select("lead", ring.alias("ring"), F.when(low, "+").otherwise("").alias("above"), F.concat(F.array(_weight(ring, 1.0)), mean).alias("members"))
    # A ring between two rows of segments has a derivation with each: the upper row's is marked.
    twice = F.count(F.lit(1)).over(W.partitionBy("lead", "ring")) > 1
    name = F.concat("ring", F.lit("-rowmean"), F.when(twice, F.col("above")).otherwise(F.lit("")))
    return same.select("lead", *_pair(F.col("p.upper"), F.col("p.lower"))).union(means.select("lead", name.alias("derivation"), "members"))


def _complete(contacts: DataFrame, scheme: str) -> DataFrame:
    """lead, derivation, contact, w, missing: the derivation's contacts that aren't available."""
    each = derivations(contacts, scheme).select("lead", "derivation", F.inline("members"))
    there = contacts.select("lead", "contact", "available")
    gone = F.when(~F.coalesce(F.col("available"), F.lit(False)), F.col("contact"))
    missing = F.sort_array(F.collect_set(gone).over(W.partitionBy("lead", "derivation")))
    return each.join(there, ["lead", "contact"], "left").withColumn("missing", missing)


def montage_weights(contacts: DataFrame, scheme: str) -> DataFrame:
    """lead, derivation, contact, w of a scheme; derivations that need a missing contact are left out."""
    return _complete(contacts, scheme).where(F.size("missing") == 0).select("lead", "derivation", "contact", "w")


def montage_notes(contacts: DataFrame, scheme: str) -> DataFrame:
    """lead, derivation, missing: what was left out, and for want of which contacts; a null derivation: no rows to derive from."""
    dropped = _complete(contacts, scheme).where(F.size("missing") > 0).select("lead", "derivation", "missing").distinct()
    if scheme not in ("bipolar_horizontal", "bipolar_vertical"):
        return dropped
    sizes = contacts.groupBy("lead", "row").agg(F.count("contact").alias("n")).groupBy("lead").agg(
        F.count_if(F.col("n") > 1).alias("segments"), F.count_if(F.col("n") == 1).alias("rings")
    )
    none = sizes.where("segments = 0" if scheme == "bipolar_horizontal" else "segments > 0 and rings = 0")
    return dropped.union(none.select("lead", F.lit(None).cast("string"), F.array().cast("array<string>")))


def apply_montage(values: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """sum(w * value) per derivation and ``by``; derivations with a contact missing are left out."""
    sizes = weights.groupBy("lead", "derivation").agg(F.count(F.lit(1)).alias("contacts"))
    out = values.join(weights, ["lead", "contact"]).groupBy("lead", "derivation", *by).agg(
        F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("held")
    )
    return out.join(sizes, ["lead", "derivation"]).where("held = contacts").drop("held", "contacts")
