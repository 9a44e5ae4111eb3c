"""Montages on drawn leads against their definitions, spelled out contact by contact."""

import random

import pytest

from tidewave.operators import catalog as C
from tidewave.plans import registry


def draw_lead(rng):
    """Rows from the tip up, each of one to four contacts; one in six contacts is gone."""
    rows = [rng.choice([1, 1, 2, 3, 4]) for _ in range(rng.randint(2, 6))]
    return [(f"{chr(65 + r)}{k}", r, k, rng.random() > 1 / 6) for r, n in enumerate(rows) for k in range(n)]


LEADS = {f"lead{i}": draw_lead(random.Random(i)) for i in range(14)}


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [(lead, name, row, 10 * row + k, there) for lead, own in LEADS.items() for name, row, k, there in own]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "lead string, contact string, row int, pos int, available boolean")


def rows_of(own):
    out = {}
    for name, row, _, _ in own:
        out.setdefault(row, []).append(name)
    return [out[r] for r in sorted(out)]


def minus(a, others):
    weights = {a: 1.0}
    for b in others:
        weights[b] = weights.get(b, 0.0) - 1 / len(others)
    return weights


def vertical(own):
    rows = rows_of(own)
    rings = [r for r, names in enumerate(rows) if len(names) == 1]
    pairs = {}
    for r, names in enumerate(rows):
        if len(names) > 1 and rings:
            near = min(rings, key=lambda q: (abs(q - r), q))
            pairs |= {f"{c}-{rows[near][0]}": minus(c, rows[near]) for c in names}
    if len(rings) > 1:
        pairs[f"{rows[rings[-1]][0]}-{rows[rings[0]][0]}"] = minus(rows[rings[-1]][0], rows[rings[0]])
    return pairs


def horizontal(own):
    pairs = {}
    for names in rows_of(own):
        n = len(names)
        # Two segments are one pair; more go round.
        for k in range(n if n > 2 else n - 1):
            a, b = names[k], names[(k + 1) % n]
            pairs[f"{a}-{b}"] = minus(a, [b])
    return pairs


def complete(pairs, own):
    there = {name for name, _, _, ok in own if ok}
    return {name: w for name, w in pairs.items() if set(w) <= there}


def got(contacts, scheme):
    out = {lead: {} for lead in LEADS}
    for r in C.montage_weights(contacts, scheme).collect():
        out[r["lead"]].setdefault(r["derivation"], {})[r["contact"]] = r["w"]
    return out


def same(found, want):
    assert set(found) == set(want)
    for name, weights in want.items():
        assert found[name] == pytest.approx(weights)


@pytest.mark.parametrize(("scheme", "define"), [("bipolar_vertical", vertical), ("bipolar_horizontal", horizontal)])
def test_pairs_are_those_of_the_definition(contacts, scheme, define):
    found = got(contacts, scheme)
    for lead, own in LEADS.items():
        pairs = define(own)
        if scheme == "bipolar_horizontal" and any(len(names) == 2 for names in rows_of(own)):
            continue  # rows of two are told apart below
        same(found[lead], complete(pairs, own))


def test_what_is_left_out_is_noted_with_the_contacts_that_lack(contacts):
    notes = {}
    for r in C.montage_notes(contacts, "bipolar_vertical").where("derivation is not null").collect():
        notes.setdefault(r["lead"], {})[r["derivation"]] = set(r["missing"])
    for lead, own in LEADS.items():
        gone = {name for name, _, _, ok in own if not ok}
        want = {name: set(w) & gone for name, w in vertical(own).items() if set(w) & gone}
        assert notes.get(lead, {}) == want


@pytest.mark.parametrize("scheme", ["bipolar_vertical", "bipolar_horizontal", "bipolar_adjacent", "chain", "car"])
def test_differences_cancel_what_all_contacts_share(contacts, scheme):
    there = {(lead, name) for lead, own in LEADS.items() for name, _, _, ok in own if ok}
    for lead, derived in got(contacts, scheme).items():
        for weights in derived.values():
            assert sum(weights.values()) == pytest.approx(0.0, abs=1e-9) and {(lead, c) for c in weights} <= there


def test_the_common_average_is_of_what_is_there(contacts):
    found = got(contacts, "car")
    for lead, own in LEADS.items():
        there = [name for name, _, _, ok in own if ok]
        want = {f"{c}-car": {d: (d == c) - 1 / len(there) for d in there} for c in there} if len(there) > 1 else None
        if want:
            same(found[lead], want)


def test_single_contacts_stand_for_themselves(contacts):
    found = got(contacts, "monopolar")
    for lead, own in LEADS.items():
        assert found[lead] == {name: {name: 1.0} for name, _, _, ok in own if ok}
    with pytest.raises(ValueError, match="unknown scheme"):
        C.montage_weights(contacts, "laplace")


def test_rows_of_one_size_pair_up_and_others_meet_by_their_mean(spark):
    rows = [("l", "t", 0, 0, True), ("l", "u0", 1, 0, True), ("l", "u1", 1, 1, True), ("l", "v0", 2, 0, True), ("l", "v1", 2, 1, True), ("l", "w", 3, 0, True)]
    frame = spark.createDataFrame(rows, "lead string, contact string, row int, pos int, available boolean")
    found = {}
    for r in C.montage_weights(frame, "bipolar_adjacent").collect():
        found.setdefault(r["derivation"], {})[r["contact"]] = r["w"]
    assert found == {
        "t-rowmean": {"t": 1.0, "u0": -0.5, "u1": -0.5}, "v0-u0": {"v0": 1.0, "u0": -1.0}, "v1-u1": {"v1": 1.0, "u1": -1.0}, "w-rowmean": {"w": 1.0, "v0": -0.5, "v1": -0.5},
    }


def test_overlaps_among_ties_and_windows_without_an_end(spark, tmp_path):
    # Windows of one start and end in falling order of their keys; a window without an end beside one of its start.
    orders = [(1, 81), (1, 41), (1, 1), (2, None), (2, 5)]
    spark.createDataFrame([(c, k, "1995-01-01") for c, k in orders], "o_custkey long, o_orderkey long, o_orderdate string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.QUERIES["overlapping_windows"](spark, str(tmp_path)).collect()
    assert sorted((r["o_custkey"], r["o_orderkey"] or 0, r["latest_end"] - r["t0"]) for r in got) == [(1, 41, 2), (1, 81, 2), (2, 0, 6)]
