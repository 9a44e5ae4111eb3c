"""The queries without SQL against brute force or held-out truth, and the pipeline stage by stage."""

import importlib.util
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, brute_lines, brute_suffixes
from tests.test_oracle import SF, TABLES, rows_of
from tidewave.llm import decontaminate, langid, line_dedup, mixing, quality, registry, similar, suffix_dedup
from tidewave.llm.common import cut, table

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    got = rows_of(registry.QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(duck.sql(registry.ORACLES[name]).df())


def test_language_id_on_held_out_documents(spark):
    found = langid.op6_langid(spark, LARGER).toPandas()
    truth = table(spark, LARGER, "documents").select("doc_id", "lang").toPandas()
    both = truth.merge(found, on="doc_id")
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = both[both["held_out"] & both["lang"].notna()]
    assert len(both) == len(truth) and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_quality_on_held_out_documents(spark):
    larger = "/root/testdata/sf0.1"
    found = quality.op9_quality(spark, larger).toPandas()
    truth = table(spark, larger, "labels").toPandas().merge(found, on="doc_id")
    held = truth[truth["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)]
    assert ((held["p_quality"] >= 0.5) == (held["quality"] == 1)).mean() > 0.95
    told, toxic = held["p_toxic"] >= 0.5, held["toxic"] == 1
    assert (told & toxic).sum() / toxic.sum() > 0.8 and (told & toxic).sum() / told.sum() > 0.9


def test_suffix_dedup_of_the_whole_table(spark):
    documents = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, SF).collect())
    assert got == sorted(brute_suffixes(documents))


#: Sentences in languages that the tables don't hold.
FOREIGN = (
    "Aurinko nousee aikaisin aamulla ja linnut laulavat puutarhan puissa samalla kun kylän ihmiset valmistautuvat lähtemään töihin",
    "Солнце встает рано утром и птицы поют в саду", "Η αυγή έρχεται νωρίς", "日が昇ると鳥たちは庭で歌います", "qxz wvk zzq kxj vvq xzx",
)


def test_language_stage_rejects_foreign_texts_of_any_length(spark):
    docs = table(spark, LARGER, "documents")
    rows = [(10_000_000 + 100 * i + n, " ".join([t] * n), None, "s", 0) for i, t in enumerate(FOREIGN) for n in (1, 3, 40)]
    rows += [(20_000_000 + i, t[:12], None, "s", 0) for i, t in enumerate(FOREIGN[1:4])]
    extra = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"] for r in langid.keep_languages(docs.unionByName(extra)).select("doc_id").collect()}
    assert not kept & {r[0] for r in rows}
    own = {r["doc_id"] for r in docs.where("length(text) > 40").select("doc_id").collect()}
    assert len(own - kept) <= 0.002 * len(own)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't there")
def test_pipeline_stage_by_stage(spark, duck):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    kept = {n: None for n in stages}
    before = docs
    for name, stage in stages.items():
        kept[name] = (before.collect(), cut(stage(spark, before, SF)))
        before = kept[name][1]
        assert name == "mixing" or before.columns == docs.columns

    rows, after = kept["language_id"]
    assert len(rows) - after.count() <= 0.01 * len(rows)
    rows, after = kept["line_dedup"]
    want = sorted((i, text) for i, _, _, text in brute_lines([(r["doc_id"], r["text"]) for r in rows]))
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == want
    rows, after = kept["near_dedup"]
    want = sorted(i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows]) if i == c)
    assert sorted(r["doc_id"] for r in after.collect()) == want
    rows, after = kept["decontamination"]
    shingle = lambda t: {tuple(w[j : j + 5]) for w in [(t or "").lower().split()] if w for j in range(max(1, len(w) - 4))}
    items = [shingle(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = sorted(r["doc_id"] for r in rows if not any(b and 100 * len(shingle(r["text"]) & b) >= 75 * len(b) for b in items))
    assert sorted(r["doc_id"] for r in after.collect()) == want
    rows, after = kept["mixing"]
    frame = before.sparkSession.createDataFrame(rows, docs.schema).toPandas()  # noqa: F841
    duck.register("mixed_documents", frame)
    want = rows_of(duck.sql(mixing.ORACLE.format(documents="mixed_documents")).df())
    assert rows_of(after.toPandas()) == want


def trigrams_by_hand(text):
    """Runs of letters with a gap before, between and after them; without a letter, nothing."""
    out, gap = "", True
    for c in text.lower():
        if c.isalpha():
            out += ("\0" if gap else "") + c
            gap = False
        else:
            gap = True
    out = out + "\0" if out else ""
    return [out[i : i + 3] for i in range(len(out) - 2)]


def test_language_id_against_plain_binding_and_bundling(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SF, "documents").collect()]
    letters = langid.Hypervectors(langid.DIMENSIONS)
    bound = {}

    def bundle(text):
        total = np.zeros(langid.DIMENSIONS)
        for t in trigrams_by_hand(text):
            if t not in bound:
                a, b, c = (letters.letter(ord(x)).astype(float) for x in t)
                bound[t] = np.roll(a, 2) * np.roll(b, 1) * c
            total += bound[t]
        return total

    bundles = {i: bundle(text or "") for i, text, _ in rows}
    sums = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and text is not None:
            sums[lang] = sums.get(lang, 0) + bundles[i]
    want = {}
    for i, v in bundles.items():
        if not v.any():
            want[i] = ("und", 0.0)
            continue
        cosines = {k: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for k, s in sorted(sums.items())}
        best = max(cosines, key=lambda k: (round(cosines[k], 12), [-ord(c) for c in k]))
        want[i] = (best, max(0.0, cosines[best]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op6_langid(spark, SF).collect()}
    assert set(got) == set(want) and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_quality_against_posteriors_by_hand(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    seen = quality.evidence(docs, quality.learn(docs, labels), F.col("source"), F.col("lang")).toPandas()
    got = quality.judge(docs, labels, F.col("source"), F.col("lang")).toPandas()
    both = seen.merge(got, on="doc_id", suffixes=("", "_"))
    assert len(both) == len(docs.collect())
    logit = lambda p: np.log(p / (1 - p))
    for head in ("quality", "toxic"):
        p = 1 / (1 + np.exp(-seen[head]))
        host, path = seen["source"] if "source" in seen else seen["host"], list(zip(seen["host"], seen["section"], strict=True))
        mean = p.mean()

        def strength(keys, centre):
            between = n_sites = 0
            for k in set(keys):
                at = np.array([x == k for x in keys])
                between += at.sum() * (p[at].mean() - centre[k]) ** 2
                n_sites += 1
            tau2 = max(0.0, (between - mean * (1 - mean) * n_sites) / len(keys))
            return min(1e6, max(1.0, mean * (1 - mean) / tau2 - 1)) if tau2 > 0 else 1e6

        host = list(host)
        k = strength(host, dict.fromkeys(host, mean))
        sums = lambda keys, x: (sum(p[i] for i, y in enumerate(keys) if y == x), keys.count(x))  # noqa: E731, B023
        hosts = {h: (sums(host, h)[0] + k * mean) / (sums(host, h)[1] + k) for h in set(host)}
        k = strength(path, {x: hosts[x[0]] for x in path})
        paths = {x: (sums(path, x)[0] + k * hosts[x[0]]) / (sums(path, x)[1] + k) for x in set(path)}
        for i, r in both.iterrows():
            z = r[head] + quality.SITE_WEIGHT * (logit(paths[(r["host"], r["section"])]) - logit(mean))
            assert r[f"p_{head}"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
            if head == "quality":
                assert (r["host_rate"], r["path_rate"]) == (pytest.approx(hosts[r["host"]]), pytest.approx(paths[(r["host"], r["section"])]))


def test_columns_with_clashing_names_pass_through(spark):
    docs = table(spark, SF, "documents")
    clash = docs
    for c in ("id", "gone_id", "_d", "_h", "d", "h", "doc", "score", "lang_pred", "band", "component", "digest", "batch", "n", "shingles", "positions", "size"):
        clash = clash.withColumn(c, F.lit(7))
    bench = table(spark, SF, "benchmark").withColumn("doc_id", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("n_item", F.lit(3))
    for stage in (similar.near_dedup, langid.keep_languages, line_dedup.drop_repeated_lines, lambda d: decontaminate.remove_contaminated(d, bench)):
        plain, odd = stage(docs), stage(clash)
        assert odd.columns == clash.columns and sorted(r["doc_id"] for r in odd.collect()) == sorted(r["doc_id"] for r in plain.collect())
    for whole in (similar.near_components, suffix_dedup.dedup_spans, mixing.mix_sources):
        assert whole(clash).count() == docs.count()
    judged = quality.judge(clash.withColumn("host", F.lit("x")), table(spark, SF, "labels").withColumn("text", F.lit("y")), F.col("source"), F.col("lang"))
    assert judged.count() == docs.count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't there")
def test_pipeline_of_odd_documents(spark):
    import corpus_pipeline

    def through(docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, SF))
        return docs, cut(corpus_pipeline.STAGES[-1][1](spark, docs, SF))

    docs = table(spark, SF, "documents").where("length(text) > 200").limit(30)
    first = docs.first()
    odd = [
        (None, first["text"] + " and more of it", "en", None, None), (10**9 + 1, None, "en", "s", 1), (10**9 + 2, "", None, None, None), (10**9 + 3, "123 !!", "en", "s", 6),
        *[(2 * 10**9 + i, first["text"], first["lang"], "copies", 5) for i in range(300)], (2 * 10**9, first["text"], first["lang"], "copies", 5),
    ]
    mixed = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("size", F.lit("clash")).withColumn("component_id", F.lit(1))
    kept, taken = through(mixed)
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert kept.columns == mixed.columns and taken.count() == len(ids) and not {10**9 + 1, 10**9 + 2, 10**9 + 3} & set(ids)
    # Line dedup leaves the copies' long lines to one of them; near-dedup one of what is left of the others.
    copies = [r for r in rows if (r["doc_id"] == first["doc_id"] or (r["doc_id"] or 0) >= 2 * 10**9) and r["text"].strip()]
    assert 1 <= len(copies) <= 2 and ids.count(None) == 1, [(r["doc_id"], r["text"][:60], len(r["text"])) for r in copies]
    nothing, none_taken = through(mixed.limit(0))
    assert nothing.count() == none_taken.count() == 0
    assert through(docs.withColumn("lang", F.lit(None).cast("string")))[1].count() == 0
