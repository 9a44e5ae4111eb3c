"""The manifest's rules with one planted fault each, and drafting from recordings."""

import pytest

from tidewave.operators import manifest as M

ROWS = {
    "subjects": ["S1,a,R,edf,S1/a,a,,"],
    "streams": ["S1,a,neur,4,1000.0,V,neural,,"],
    "leads": ["S1,a,L,stn,R,four,1,4,0,"],
    "channels": [f"S1,a,neur,{i + 1},c{i},stn,L,{i},,true," for i in range(4)],
    "windows": ["S1,a,rest,0.0,2.0,emg,in_use,", "S1,a,rest,2.0,4.0,emg,in_use,", "S1,a,move,1.0,3.0,emg,in_use,"],
    "coordinates": [f"S1,a,L,{i},1.0,2.0,3.0,mni,planning" for i in range(4)],
}
WORDS = {
    "regions": ["stn"], "conditions": ["rest", "move"], "window_sources": ["emg", "assumed"], "window_status": ["in_use", "under_revision"],
    "coordinate_spaces": ["mni", "native"], "coordinate_sources": ["planning"],
}

#: table, row (None: a new one), its text, and what is said of it
FAULTS = [
    ("streams", None, "S9,a,x,1,1.0,V,neural,,", {"no row in subjects"}),
    ("channels", 0, "S1,a,neur,one,c0,stn,L,0,,true,", {"ch_index is not an integer"}),
    ("channels", 0, "S1,a,neur,0,c0,stn,L,0,,true,", {"ch_index counts from 1"}),
    ("channels", 0, "S1,a,neur,5,c0,stn,L,0,,true,", {"ch_index is beyond the stream's channels"}),
    ("channels", 0, "S1,a,neur,02,c0,stn,L,0,,true,", {"ch_index is there more than once"}),
    ("channels", 3, None, {"n_channels differs from the rows of channels"}),
    ("channels", None, "S1,a,mic,1,m,stn,,,,yes,", {"no row in streams"}),
    ("channels", 0, "S1,a,neur,1,c0,stn,L,0,,maybe,", {"include must be true or false"}),
    ("channels", 0, "S1,a,neur,1,c0,stn,L,0,,no,", {"excluded without a reason"}),
    ("channels", 0, "S1,a,neur,1,c0,gpi,L,0,,true,", {"unknown region"}),
    ("channels", 0, "S1,a,neur,1,c0,stn,Q,0,,true,", {"no row in leads"}),
    ("channels", 0, "S1,a,neur,1,c0,stn,L,9,,true,", {"not a contact of the lead's model"}),
    ("leads", 0, "S1,a,L,stn,R,nine,1,4,0,", {"lead_model is not defined"}),
    ("leads", 0, "S1,a,L,stn,R,four,1,5,0,", {"the channel range differs from the model's contacts"}),
    ("leads", 0, "S1,a,L,stn,R,four,1,x,0,", {"channel_first and channel_last must be integers"}),
    ("leads", 0, "S1,a,L,stn,R,four,1,4,,", {"rotation_deg is empty: no claims of direction"}),
    ("coordinates", 0, "S1,a,Q,0,1.0,2.0,3.0,mni,planning", {"no row in leads"}),
    ("coordinates", 0, "S1,a,L,9,1.0,2.0,3.0,mni,planning", {"not a contact of the lead's model"}),
    ("coordinates", 0, "S1,a,L,1,1.0,2.0,3.0,mni,planning", {"more than one row"}),
    ("coordinates", 0, "S1,a,L,0,1.0,,3.0,native,guess", {"y_mm must be a number", "a native space isn't comparable across subjects", "unknown source"}),
    ("windows", 0, "S1,a,sleep,0.0,2.0,emg,in_use,", {"unknown condition"}),
    ("windows", 0, "S1,a,rest,0.0,2.0,guess,odd,", {"unknown derived_from", "unknown status"}),
    ("windows", 0, "S1,a,rest,0.0,2.0,assumed,under_revision,", {"assumed, not measured", "under revision"}),
    ("windows", 0, "S1,a,rest,0.0,2.5,emg,in_use,", {"overlaps the next window of its condition"}),
    ("windows", 2, "S1,a,move,3.0,3.0,emg,in_use,", {"t_end_s must exceed t_start_s"}),
    ("windows", 2, "S1,a,move,x,3.0,emg,in_use,", {"t_start_s and t_end_s must be numbers"}),
]


def tables(spark, table=None, row=None, text=None, study="S1"):
    out = {}
    for name, lines in ROWS.items():
        lines = [x.replace("S1", study) for x in lines]
        if name == table:
            lines = [*lines, text] if row is None else [x if i != row else text for i, x in enumerate(lines)]
        out[name] = [x.split(",") for x in lines if x is not None]
    return out


def frames(spark, studies):
    return {n: spark.createDataFrame([r for s in studies for r in s[n]], ", ".join(f"{c} string" for c in M.columns_of(n))) for n in ROWS}


def test_every_rule(spark):
    # One study per fault, all judged at once.
    studies = [tables(spark)]
    for i, (table, row, text, _) in enumerate(FAULTS):
        own = tables(spark, table, row, text.replace("S1", f"F{i}") if text else None, study=f"F{i}")
        studies.append(own)
    found = {}
    models = M.model_contacts(spark, {"four": ["0", "1", "2", "3"]})
    for r in M.problems(frames(spark, studies), models, WORDS).collect():
        found.setdefault(r["study_id"], set()).add(r["problem"])
    want = {("S9" if text and text.startswith("S9") else f"F{i}"): said for i, (_, _, text, said) in enumerate(FAULTS)}
    assert found == want


def test_folders_of_text(spark, tmp_path):
    (tmp_path / "subjects.csv").write_text('session,study_id,notes\n a ,S1,"two, parts"\n')
    (tmp_path / "channels.csv").write_text("study_id,session,stream,ch_index,include\nS1,a,n,1,Yes\nS1,a,n,2,\nS1,b,n,1,no\n")
    got = M.load(spark, str(tmp_path))
    assert [tuple(r) for r in got["subjects"].select("study_id", "session", "notes", "format").collect()] == [("S1", "a", "two, parts", "")]
    assert got["windows"].count() == 0 and got["windows"].columns == M.columns_of("windows")
    assert M.channels_for(got, "S1", "a").count() == 2 and M.included(got["channels"]).count() == 1 and M.subject_keys(got).count() == 1


def test_drafts_and_their_commit(spark):
    chunks = spark.createDataFrame(
        [("/x/S2/b/rec", "edf", "eeg", c, 250.0, 0, [1.0], None) for c in ("c1", "c2")] + [("/x/S2/c/rec", None, None, None, None, None, None, "ValueError: bad")],
        "path string, format string, stream string, channel string, sfreq double, t0_idx long, x array<double>, error string",
    )
    drafted = M.draft(chunks)
    assert [tuple(r)[:4] for r in drafted["streams"].collect()] == [("S2", "b", "eeg", "2")]
    assert [r["root_relpath"] for r in drafted["subjects"].collect()] == ["S2/b"] and [r["session"] for r in drafted["unreadable"].collect()] == ["c"]
    old, models = frames(spark, [tables(spark)]), M.model_contacts(spark, {"four": ["0", "1", "2", "3"]})
    merged, errors = M.commit(old, drafted, models, WORDS)
    assert errors.count() == 0 and merged["subjects"].count() == 2
    _, again = M.commit(merged, drafted, models, WORDS)
    assert {r["problem"] for r in again.collect()} == {"more than one row"}
    with pytest.raises(KeyError):
        M.columns_of("nothing")
