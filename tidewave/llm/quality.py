"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. A document's evidence comes from two logistic heads: good or poor, toxic or not. Both
   see the same two sets of features: measures of style, and how telling the text's tokens
   are. A token's tale is its shrunk log odds in the labelled texts that hold it, against
   those of all (hashed to ``BUCKETS``); a text gives the three strongest, their mean and
   the mean of the positive ones. A labelled text's own tale leaves that text out, so
   that rare tokens don't look better than they are. The heads are fitted on at most
   ``TRAIN_ROWS`` labelled documents outside the held-out fold (those with the smallest md5
   of their id); only counts per bucket and ``N_FEATURES`` numbers per labelled document and
   head reach the driver. The rest of the work covers all documents.
2. Every document's probability is added up, by grouped aggregation, per path (host
   and section), per host and over all. Each level's mean is shrunk to the level above:
   (sum + k * mean above) / (n + k). The weight k is estimated from the data by
   moments: the variance between sites beyond what their sizes explain.
3. The document's log odds are shifted from the global rate to its path's posterior:
   logit(p) = evidence - logit(global) + logit(path). ``SITE_WEIGHT`` tempers the
   shift, since a site's mean holds the document's own evidence too.

A document is kept if it is more likely good than not and less likely toxic than not.

Defined results for odd input: a null or empty text is judged as a text without tokens;
null host or section are a site of their own; documents without doc_id are judged
and returned, never learned from; several labels of a document each count; without
labels of both kinds a head gives 0.5 for all; repeated rows are judged alike; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import cut, forget, require, table
from tidewave.llm.langid import held_out

TRAIN_ROWS = 10_000
BUCKETS = 1 << 18
SITE_WEIGHT = 0.5
HEADS = ("quality", "toxic")
#: A token's log odds are shrunk as if it had been seen this often at the usual rate.
SHRINK = 2.0
STRONGEST = 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _kinds() -> np.ndarray:
    """For every code point below 2^16: 1 for a letter, 3 for an upper-case one, else 0."""
    return np.array([c.isalpha() + 2 * (c.isalpha() and c.isupper()) for c in map(chr, range(1 << 16))], np.uint8)


class Features:
    """Hashed tokens of a text, and its style."""

    STYLE = 9

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.kinds = _kinds()

    def token(self, word: str) -> int:
        if word not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return self.seen[word]

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        hashed = np.unique(np.fromiter(map(self.token, tokens), np.int64, len(tokens)))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes[codes < 1 << 16]]
        n, words = max(1, len(text)), max(1, len(tokens))
        letters = max(1, int(np.count_nonzero(kinds)))
        plain = [t for t in tokens if t[0].isalnum()]
        lines = text.split("\n")
        style = np.array(
            [
                1.0,
                np.log1p(len(tokens)) / 5,
                np.count_nonzero(kinds == 3) / letters,
                1 - letters / n,
                1 - len(plain) / words,
                sum(not t[0].isalnum() and t not in ".,;:?" for t in tokens) / words,
                sum(x == y for x, y in zip(plain, plain[1:])) / words,
                len(set(tokens)) / words,
                len(set(lines)) / len(lines),
            ]
        )
        return hashed, style


N_FEATURES = Features.STYLE + STRONGEST + 2


def log_odds(yes, no, rate: float) -> np.ndarray:
    """Shrunk log odds of tokens seen in so many texts of either kind, against the usual rate."""
    p = (yes + SHRINK * rate) / (yes + no + SHRINK)
    return np.log(p / (1 - p)) - np.log(rate / (1 - rate))


def telling(odds: np.ndarray) -> np.ndarray:
    """What a text's token log odds come to: the strongest, the mean, the mean of the positive ones."""
    if not len(odds):
        return np.zeros(STRONGEST + 2)
    top = np.zeros(STRONGEST)
    best = np.sort(odds)[::-1][:STRONGEST]
    top[: len(best)] = best
    return np.concatenate([top, [odds.mean(), np.maximum(odds, 0).mean()]])


class Head:
    """A fitted head: log odds per bucket and weights of style and tale; None where it could not be fitted."""

    def __init__(self, odds: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.odds, self.weights = odds, weights

    def __call__(self, hashed: np.ndarray, style: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        return float(np.clip(np.concatenate([style, telling(self.odds[hashed].astype(float))]) @ self.weights, -30, 30))


def fit_logistic(features: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps on scaled features."""
    # A measure that never varies, as the intercept, is taken as it is.
    spread = features.std(axis=0)
    scale = np.where(spread > 1e-9, spread, 1.0)
    x, w = features / scale, np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return w / scale


def learn(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, Head]:
    """The heads, from a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), *[F.col(h).cast("int").alias(h) for h in HEADS])
    ranked = known.orderBy(F.md5(F.col("_id").cast("string")), "_id", *HEADS).limit(train_rows)
    texts = documents.select("doc_id", "text").join(ranked, F.col("doc_id") == F.col("_id")).select("text", *HEADS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.of(x) for x in batch["text"].to_pylist()]
            hashed = pa.array([h.astype(np.int32) for h, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([hashed, pa.array([x for _, x in rows], pa.list_(pa.float64())), *(batch[h] for h in HEADS)], names=["hashed", "style", *HEADS])

    sample = cut(texts.mapInArrow(read, "hashed array<int>, style array<double>, quality int, toxic int"))
    counts = sample.select(F.explode("hashed").alias("bucket"), *HEADS).groupBy("bucket").agg(
        *[F.count_if(F.col(h) == v).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]
    )
    counts = counts.toArrow()  # at most BUCKETS rows
    at = counts["bucket"].to_numpy()
    seen = {}
    for h in HEADS:
        for v in (0, 1):
            seen[h, v] = np.zeros(BUCKETS, np.int32)
            seen[h, v][at] = counts[f"{h}{v}"].to_numpy()
    kinds = sample.agg(*[F.count_if(F.col(h) == v).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]).first()
    rates = {h: kinds[f"{h}1"] / (kinds[f"{h}0"] + kinds[f"{h}1"]) for h in HEADS if kinds[f"{h}0"] and kinds[f"{h}1"]}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, rate in rates.items():
                out, ys = [], []
                for hashed, style, y in zip(batch["hashed"], batch["style"], batch[h].to_pylist(), strict=True):
                    if y in (0, 1):
                        k = hashed.values.to_numpy()
                        odds = log_odds(seen[h, 1][k] - y, seen[h, 0][k] - (1 - y), rate)  # without this text
                        out.append(np.concatenate([style.values.to_numpy(), telling(odds)]))
                        ys.append(y)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(ys), pa.string()), pa.array(out, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["head", "x", "y"])

    heads = dict.fromkeys(HEADS, Head())
    if rates:
        rows = sample.mapInArrow(told, "head string, x array<double>, y int").toArrow()  # N_FEATURES numbers a row
        names = np.array(rows["head"].to_pylist())
        x = np.array(rows["x"].to_pylist()).reshape(-1, N_FEATURES)
        y = rows["y"].to_numpy().astype(float)
        for h, rate in rates.items():
            own, target = x[names == h], y[names == h]
            order = np.lexsort((*own.T, target))  # rows come in any order
            heads[h] = Head(log_odds(seen[h, 1], seen[h, 0], rate).astype(np.float32), fit_logistic(own[order], target[order]))
    forget(sample)
    return heads


def evidence(documents: DataFrame, heads: dict[str, Head], host: Column, section: Column) -> DataFrame:
    """doc_id, host, section and the log odds of each head for every document."""
    docs = documents.select("doc_id", host.alias("host"), section.alias("section"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "host", "section")), *(pa.array([heads[h](*f) for f in found], pa.float64()) for h in HEADS)],
                names=["doc_id", "host", "section", *HEADS],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, host string, section string, quality double, toxic double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(inside / (1 - inside))


def shrunk_sites(judged: DataFrame, head: str) -> DataFrame:
    """host, section and the posterior rates of host and path for one head."""
    p = _sigmoid(F.col(head))
    paths = cut(judged.groupBy("host", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    mean = paths.agg(F.sum("s") / F.sum("n")).first()[0]

    def strength(sites: DataFrame, n: str, s: str, centre) -> float:
        """k of the prior, by moments: mu (1 - mu) / between - 1, within [1, 1e6]."""
        if mean is None:
            return 1.0
        rate = F.col(s) / F.col(n)
        row = sites.agg(
            F.sum(F.col(n) * (rate - centre) ** 2).alias("between"), F.count(F.lit(1)).alias("m"), F.sum(n).alias("total")
        ).first()
        within = mean * (1 - mean) * row["m"]
        tau2 = max(0.0, (row["between"] - within) / max(1, row["total"]))
        return float(np.clip(mean * (1 - mean) / tau2 - 1 if tau2 > 0 else 1e6, 1.0, 1e6))

    k_host = strength(hosts, "hn", "hs", F.lit(mean))
    host_rates = hosts.withColumn("host_rate", (F.col("hs") + k_host * F.lit(mean)) / (F.col("hn") + k_host))
    both = paths.join(
        host_rates.select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h"))
    ).drop("h")
    k_path = strength(both, "n", "s", F.col("host_rate"))
    rate = (F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    return both.select("host", "section", "host_rate", rate.alias("path_rate"), F.lit(mean).alias("rate"))


def judge(
    documents: DataFrame, labels: DataFrame, host: Column, section: Column, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """doc_id, host, section, p_quality, p_toxic, host_rate, path_rate, keep of every document."""
    require(documents, ["doc_id", "text"])
    require(labels, ["doc_id", *HEADS])
    judged = cut(evidence(documents, learn(documents, labels, train_rows), host, section))
    out = judged
    for head in HEADS:
        sites = shrunk_sites(judged, head).select(
            F.col("host").alias("h"), F.col("section").alias("c"),
            *[F.col(x).alias(f"{head}_{x}") for x in ("host_rate", "path_rate", "rate")],
        )
        out = out.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("section").eqNullSafe(F.col("c")), "left")
        shift = _logit(F.col(f"{head}_path_rate")) - _logit(F.col(f"{head}_rate"))
        out = out.withColumn(f"p_{head}", _sigmoid(F.col(head) + SITE_WEIGHT * shift)).drop("h", "c")
    return out.select(
        "doc_id", "host", "section", "p_quality", "p_toxic",
        F.col("quality_host_rate").alias("host_rate"), F.col("quality_path_rate").alias("path_rate"),
        ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by text, with the source as host and its languages as paths."""
    documents = table(spark, sf_dir, "documents")
    return judge(documents, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict = {}
