"""Small and odd inputs for every operator, held against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.llm import (
    chat_format, decontaminate, langid, line_dedup, mixing, quality, similar, suffix_dedup, topk, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, None, "s", None) if len(r) == 2 else r for r in rows], DOCS)


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(n))


def odd_documents():
    """Null, empty, blank, short, repeated and very long texts, null ids and shared ids."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, base), (7, base), (7, base), (8, base + " tail end"),
        (9, "A" * 120), (10, "a" * 120), (11, "é" * 60 + "\n" + "é" * 60), (None, base), (None, None), (12, words(rng, 5000)),
    ]
    for i in range(20, 60):
        edited = base.split()
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = "x" + str(rng.randint(0, 3))
        rows.append((i, " ".join(edited)))
    return rows


# --- mixing -------------------------------------------------------------------------------


def test_mixing_targets_are_met_and_capped(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 30)), None, s, None) for i, s in enumerate(["a"] * 5 + ["b"] * 200 + ["c"] * 100)]
    rows += [(1000, None, None, None, None), (1001, "w " * 40, None, None, None)]
    mixed = mixing.mix_sources(docs_frame(spark, rows)).toPandas()
    for _, part in mixed.groupby("source", dropna=False):
        target, largest = part["target"].iloc[0], part["size"].max()
        assert abs(part["taken"].sum() - target) <= largest / 2 + 1e-6
        assert target <= 3 * part["source_size"].iloc[0] + 1e-6
    assert (mixed["taken"] <= 3 * mixed["size"]).all()
    assert mixed.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(mixed["size"].sum())


def test_mixing_follows_a_schedule(spark):
    rows = [(i, "w " * 10, None, s, None) for i, s in enumerate(["early"] * 100 + ["late"] * 100)]
    knots = "array<struct<t:double,w:double>>"
    schedule = spark.createDataFrame(
        [("early", [(0.0, 2.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (1.0, 2.0)])], f"source string, knots {knots}"
    )
    order = mixing.training_order(mixing.mix_sources(docs_frame(spark, rows), schedule=schedule)).toPandas()
    assert order["position"].is_monotonic_increasing and order["position"].between(0, 1).all()
    first = order.head(50)["source"].value_counts()
    assert first["early"] > 40
    # Half of what "late" is due comes after sqrt(1/2) of the time.
    assert order.loc[order["source"] == "late", "position"].median() == pytest.approx(0.5**0.5, abs=0.02)


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(docs_frame(spark, [])).count() == 0
    only = mixing.mix_sources(docs_frame(spark, [(1, None), (2, "  ")])).collect()
    assert [(r["taken"], r["target"], list(r["positions"])) for r in only] == [(0, 0.0, [])] * 2


# --- near-duplicates ----------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    known = [(i, s) for i, s in sets if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(known):
        for j, y in known[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def test_near_dedup_against_brute_force(spark):
    rows = odd_documents()
    got = similar.near_components(docs_frame(spark, rows)).toPandas().astype(object)
    found = sorted(((r.doc_id if r.doc_id == r.doc_id else None, r.n_shingles, r.component_id if r.component_id == r.component_id else None) for r in got.itertuples()), key=str)
    norm = lambda t: tuple(None if v is None else int(v) for v in t)
    assert sorted(map(norm, found), key=str) == sorted(map(norm, brute_components(rows)), key=str)


def test_near_dedup_of_a_large_loose_group(spark):
    rng = random.Random(9)
    base = words(rng, 80).split()
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 40)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_components(docs_frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c in brute_components(rows)}


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_of_many_small_groups(spark, seed):
    # Groups of two to five, chains among them; hubs may be any member.
    rng = random.Random(100 + seed)
    rows = []
    for g in range(60):
        text = words(rng, rng.randint(30, 90), "abcdefghij").split()
        for _ in range(rng.randint(2, 5)):
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"q{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(text)))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(ids[i], t) for i, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_components(docs_frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c in brute_components(rows)}


def test_near_dedup_keeps_columns_and_one_of_each_group(spark):
    rows = odd_documents()
    kept = similar.near_dedup(docs_frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {i for i, _, c in brute_components(rows) if i is not None and i == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert {i for i in got if i is not None} == want and got.count(None) == 2


def test_near_dedup_of_nothing(spark):
    assert similar.near_components(docs_frame(spark, [])).count() == 0
    one = similar.near_components(docs_frame(spark, [(5, None)])).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def test_match_bounds_grow_and_spare_the_threshold():
    bounds = similar.match_bounds()
    assert bounds[-1][0] == similar.N_HASHES and all(a[1] <= b[1] for a, b in zip(bounds, bounds[1:]))
    draws = np.random.default_rng(0).random((20_000, similar.N_HASHES)) < 0.75
    lost = np.zeros(len(draws), bool)
    for n, least in bounds:
        lost |= draws[:, :n].sum(axis=1) < least
    assert lost.mean() < 1e-3


# --- chat formatting ----------------------------------------------------------------------


def test_chat_round_trip_of_control_strings(spark):
    rng = random.Random(5)
    parts = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "\n", "a", "<\\|im_end|>", "im_end|>", "é", "<\\\\|im_start|>"]
    for _ in range(3000):
        role, text = ("".join(rng.choices(parts, k=rng.randint(0, n))) for n in (3, 8))
        both = chat_format.render(role, text) + chat_format.render("user", "x")
        assert [(r, t) for r, t, _, _ in chat_format.parse(both)] == [(role, text), ("user", "x")]


def test_chat_digest_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x\n"), (None, 0, "user", "n"), (1, 1, "assistant", "b"), (3, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(frame)).collect()}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 3, 2: 1, 3: 1, None: 1}
    assert got[1]["loss_chars"] == 2 and got[2]["loss_chars"] == 0 and got[3]["loss_chars"] == 0
    assert chat_format.read_back(chat_format.format_chats(frame.limit(0))).count() == 0


# --- top-k --------------------------------------------------------------------------------


def brute_top(vectors, queries, k):
    out = set()
    for q in queries:
        scored = sorted(((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    x = np.floor(r.normal(size=(300, 5)) * r.lognormal(0, 1, size=(300, 1)) * 4)
    x[100:200] = x[:100]  # ties
    vectors = {i: v for i, v in enumerate(x)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>")
    got = topk.top_k(frame.where("id % 20 = 0"), frame, 7).collect()
    assert {tuple(g) for g in got} == brute_top(vectors, range(0, 300, 20), 7)


@pytest.mark.parametrize("seed, spread", [(3, 1.5), (4, 0.0), (5, 0.3)])
def test_topk_over_many_groups_blocks_and_buckets(spark, monkeypatch, seed, spread):
    # Lengths that differ much prune whole groups, like lengths prune by coordinate.
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    r = np.random.default_rng(seed)
    x = r.normal(size=(900, 6))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * r.lognormal(0, spread, size=(900, 1)) * 500)
    x[300:400] = x[:100]  # ties
    x[10] = [2**28, 0, 0, 0, 0, 1]  # multiplied in Python integers
    x[20], x[40] = 0, x[60]
    vectors = {i: v for i, v in enumerate(x)} | {i: r.integers(-9, 9, 3).astype(float) for i in range(900, 930)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    queries = frame.where("id % 20 = 0")
    got = topk.top_k(queries.union(queries), frame, 7, group_rows=64, block_queries=9).collect()
    assert {tuple(g) for g in got} == brute_top(vectors, range(0, 930, 20), 7) and len(got) == 47 * 7


def test_topk_of_repeated_ids_and_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(g) for g in topk.top_k(frame.where("id = 0"), frame, 2).collect())
    # Two vectors under one id are two queries; a row that is there twice is two results.
    assert got == [(0, 1, 1, 2), (0, 1, 2, 3), (0, 2, 1, 2), (0, 2, 3, 1)]


def test_coordinate_range_holds_all_vectors_of_that_cosine():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in x[:50]:
        for c in (0.5, 0.9, 0.99):
            low, high = topk.coordinate_range(c, q[0])
            near = x[x @ q >= c][:, 0]
            assert (near >= low).all() and (near <= high).all()


def test_topk_leaves_out_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [-0.01, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(7))
    x = topk.scaled(frame)
    got = topk.top_k(x.where("id = 0"), x, 20).collect()
    assert {tuple(g) for g in got} == {(0, 1, 1, 64 * 32), (0, 2, 6, -64)}
    assert topk.top_k(x.limit(0), x, 3).count() == 0 and topk.top_k(x, x.limit(0), 3).count() == 0


def test_topk_with_large_vectors(spark):
    r = np.random.default_rng(7)
    plain = {i: r.integers(-99, 99, 3).tolist() for i in range(40)}
    vectors = plain | {40: [2**27 + 1, 2**27, -5], 41: [2**40, 3, 1], 42: [2**70, 0, 1], 43: [-(2**70), 1, 0]}
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors.items()], "id long, v array<double>")
    want = set()
    for q in (0, 20, 40, 42):
        products = [(i, sum(a * b for a, b in zip(vectors[q], v))) for i, v in vectors.items() if i != q]
        held = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for i, s in products)[:9]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(held, 1)}
    assert {tuple(g) for g in topk.top_k(frame.where("id in (0, 20, 40, 42)"), frame, 9).collect()} == want
    whole = topk.scaled(spark.createDataFrame([(1, [2.0**70, 0.51])], "vec_id long, embedding array<float>")).collect()
    assert whole[0]["v"] == [2.0**76, 32.0]


# --- URL filter ---------------------------------------------------------------------------


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at].lower(), rest[at:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    urls = [None, "", "nothing", "http://", "http://NET/", "https://a.net", "http://a.net/x.net/", "x://example.net/en/", "http://bexample.net/en/a?b#c", "http://fr.org/fr/#/en/"]
    pieces = ["http://", "a.", "example", ".net", ".com", ".org", "/", "en/", "de/", "fr/", "?", "#", ".", "NET", "é"]
    urls += ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(2000)] + ["http://a.net/" + "x" * 50_000]
    many = [*url_filter.RULES, *[url_filter.Rule("block", f"h{i}.net", f"/p{i}/") for i in range(40)]]
    urls += [f"http://h{i}.net/p{i % 7}/q" for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for rules in (url_filter.RULES, many):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(frame, rules).collect()}
        assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge_urls(frame, []).collect()} == {"allow"}
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


# --- language ID --------------------------------------------------------------------------


def test_language_id_learns_and_knows_what_it_cannot_tell(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 40, "aeimnt" if i % 2 else "kozwyj"), "x" if i % 2 else "y", "s", None) for i in range(200)]
    rows += [(1000, None, "x", "s", None), (1001, "12 !!", "x", "s", None), (None, "tent", None, "s", None)]
    frame = docs_frame(spark, rows)
    found = langid.identify(frame, langid.learn(frame)).select("doc.*", "lang_pred", "score").toPandas()
    known = found[found["lang"].notna() & found["text"].str.contains("[a-z]", na=False)]
    assert (known["lang"] == known["lang_pred"]).all() and found["score"].between(0, 1).all()
    assert (found[found["doc_id"].isin([1000, 1001])]["lang_pred"] == "und").all()
    kept = langid.keep_languages(frame)
    assert kept.columns == frame.columns and kept.count() == 201


def test_language_id_without_anything_to_learn(spark):
    frame = docs_frame(spark, [(1, "abc", None, "s", None)])
    assert [r["lang_pred"] for r in langid.identify(frame, langid.learn(frame)).collect()] == ["und"]
    assert langid.identify(frame.limit(0), {}).count() == 0


# --- decontamination ----------------------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(3, 60))) for i in range(20)] + [(20, None), (21, ""), (None, "a b c d e f"), (0, words(rng, 30))]
    rows = odd_documents()
    for i in range(100, 160):
        part = rng.choice(items[:20])[1].split()
        cut = part[rng.randint(0, 4) : len(part) - rng.randint(0, 6)]
        rows.append((i, words(rng, rng.randint(0, 200)) + " " + " ".join(cut).upper() + " " + words(rng, rng.randint(0, 300))))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    shingle = lambda t: {tuple(w[j : j + 5]) for w in [(t or "").lower().split()] if w for j in range(max(1, len(w) - 4))}
    want = set()
    for d, text in rows:
        for b, item in items:
            x, y = shingle(text), shingle(item)
            if b is not None and y and 100 * len(x & y) >= 75 * len(y):
                want.add((d, b))
    frame = docs_frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(frame, bench).collect()}
    assert got == want
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(d not in {a for a, _ in want} for d, _ in rows)
    assert decontaminate.contaminated_pairs(frame.limit(0), bench).count() == 0
    assert decontaminate.contaminated_pairs(frame, bench.limit(0)).count() == 0


# --- line dedup ---------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(lower)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (i is not None and len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choices("abc ", k=rng.randint(36, 60))) for _ in range(30)] + ["É" * 40, "x" * 39, "x" * 40]
    rows = [(i, "\n".join(rng.choice((str.upper, str.lower, lambda s: f" \t{s}\r"))(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(i, pool[0]) for i in range(100, 400)] + [(None, pool[0]), (500, None), (501, ""), (502, "\n\n"), (300, pool[0] + "\n" + pool[1])]
    frame = docs_frame(spark, rows)
    done = line_dedup.keep_lines(frame).select("rest.doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted((tuple(r) for r in done.collect()), key=str) == brute_lines(rows)
    kept = line_dedup.drop_repeated_lines(frame)
    assert kept.columns == frame.columns and kept.where("text is null").count() == 1
    assert line_dedup.keep_lines(frame.limit(0)).count() == 0


def test_bitmap_round_trip():
    keep = line_dedup.unpack_bitmap(line_dedup.pack_bitmap(13, [0, 5, 12]), 13)
    assert keep.tolist() == [i not in (0, 5, 12) for i in range(13)]


# --- quality ------------------------------------------------------------------------------


def test_quality_separates_and_shrinks_small_sites(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        poor, toxic = i % 5 == 0, i % 7 == 0
        text = words(rng, 60)
        text = text.upper().replace(" ", "!! ") if poor else text
        rows.append((i, text + (" awfulword" if toxic else ""), "en", "big" if i % 40 else f"small{i}", None))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None, None, None, None), (None, "", "en", "big", None)]
    frame, marks = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(frame, marks, F.col("source"), F.col("lang")).toPandas()
    assert len(got) == len(rows)
    truth = pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).merge(got, on="doc_id")
    assert ((truth["p_quality"] >= 0.5) == (truth["quality"] == 1)).mean() > 0.97
    assert ((truth["p_toxic"] >= 0.5) == (truth["toxic"] == 1)).mean() > 0.93  # 0.86 without the words
    assert got["path_rate"].between(0, 1).all()
    empty = quality.judge(frame.limit(0), marks, F.col("source"), F.col("lang"))
    assert empty.count() == 0
    blind = quality.judge(frame, marks.limit(0), F.col("source"), F.col("lang"))
    assert blind.where("abs(p_quality - 0.5) > 1e-9").count() == 0


# --- suffix dedup -------------------------------------------------------------------------


def brute_suffixes(documents, length=suffix_dedup.LENGTH):
    """String by string: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    least = {}
    for i, text in documents:
        data = (text or "").encode()
        for at in range(len(data) - length + 1) if i is not None else ():
            s = data[at : at + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, text in documents:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1) if i is not None else ():
            if least[data[at : at + length]] < i:
                gone[at : at + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((i, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_digest(done):
    got = done.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("batch_bytes, key_bytes, hot", [(700, 5, 512), (700, 1, 512), (3000, 5, 1), (1 << 20, 5, 512)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, batch_bytes, key_bytes, hot):
    # Fingerprints of one byte match often: they may propose windows, and remove nothing.
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", key_bytes)
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    rng = random.Random(13)
    passages = [words(rng, 25, "abcé") for _ in range(6)]
    rows = [(i, words(rng, rng.randint(0, 30), "abc") + rng.choice(passages)[: rng.randint(0, 90)] + words(rng, 9, "bcd")) for i in range(60)]
    rows += [*odd_documents(), (70, rows[3][1]), (71, rows[3][1]), (80, "ab" * 200), (81, "ab" * 60), (82, passages[0] + passages[0])]
    rows += [(90, "\0" * 70), (91, "x" + "\0" * 49), (92, "\0" * 50), (-5, passages[1] * 3)]
    rng.shuffle(rows)  # batches need not come in order of doc_id
    frame = docs_frame(spark, rows).withColumn("batch", F.lit("clash"))
    done = suffix_dedup.dedup_spans(frame, batch_bytes=batch_bytes, bucket_bytes=500)
    assert suffix_digest(done) == sorted(brute_suffixes(rows), key=str)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.dedup_spans(docs_frame(spark, [])).count() == 0
    assert suffix_dedup.dedup_spans(docs_frame(spark, [(None, None)])).count() == 1


def test_levels_are_sorted_and_double():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1200] = text[:200]
    family = suffix_dedup.LogarithmicFamily(text)
    numbers, at = [], 0
    while at + 40 <= len(text) - suffix_dedup.LENGTH + 1:
        places = np.arange(at, at + 40)
        numbers.append(family.add(places, np.full(40, 1000 - at)))
        sizes = list(map(len, family.levels))
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            strings = [text[p : p + suffix_dedup.LENGTH].tobytes() for p in family.place[level]]
            assert strings == sorted(set(strings))
        at += 40
    smallest = family.smallest()
    least = {}
    for p in range(at):
        s = text[p : p + suffix_dedup.LENGTH].tobytes()
        least[s] = min(least.get(s, 1 << 60), 1000 - p // 40 * 40)
    assert [least[text[p : p + suffix_dedup.LENGTH].tobytes()] for p in range(at)] == smallest[np.concatenate(numbers)].tolist()


# --- long texts and repeated rows --------------------------------------------------------


def test_long_texts_and_repeated_rows_are_judged_whole_and_alike(spark):
    rng = random.Random(21)
    long_text = words(rng, 150_000, "kozwyj")
    rows = [(i, words(rng, 40, "aeimnt" if i % 2 else "kozwyj"), "x" if i % 2 else "y", "s", None) for i in range(60)]
    rows += [(500, long_text, None, "s", None)] * 3 + [(501, "tent mean", None, "s", None)] * 2
    frame = docs_frame(spark, rows)
    found = langid.identify(frame, langid.learn(frame)).select("doc.doc_id", "lang_pred", "score").where("doc_id >= 500").collect()
    assert len(found) == 5 and len(set(map(tuple, found))) == 2 and {r["lang_pred"] for r in found if r["doc_id"] == 500} == {"y"}
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(frame, marks, F.col("source"), F.col("lang")).where("doc_id >= 500").collect()
    assert len(judged) == 5 and len(set(map(tuple, judged))) == 2
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(pages).orderBy("page_id").collect()] == ["block", "block", "allow"]
    # Beyond 2^24 occurrences counts are added exactly.
    vectors, key = langid.Hypervectors(64), np.array([(97 << 42) | (98 << 21) | 99])
    assert (vectors.bundle(key, np.array([(1 << 24) + 1])) == ((1 << 24) + 1) * vectors.bind(int(key[0])).astype(float)).all()
