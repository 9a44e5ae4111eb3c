"""Language ID with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1 in
``DIMENSIONS`` dimensions, drawn from its code point. A trigram's vector binds its
letters' vectors, each rotated by its place: roll(a, 2) * roll(b, 1) * c. A document's
vector bundles (adds) the vectors of its trigrams, a language's prototype those of
all documents it learns from. A document gets the language of the prototype with the
highest cosine; the score is that cosine, at least 0.

Since bundling is a sum, prototypes are built from trigram counts per language: tasks
count, Spark adds the counts up by (language, trigram), tasks bind and bundle the
counted trigrams, and Spark adds the parts up by (language, dimension). The driver
gets ``DIMENSIONS`` numbers per language, whatever the size of the corpus.

Defined results for odd input: a null text, or one without any letter, is ``und``
with score 0; without anything to learn from all documents are ``und``; rows without
a doc_id are held out (never learned from); equal cosines go to the first language by
code point; keep_languages rejects by one rule at every length (see ``SHARE``); repeated rows count as often as they occur and get the same answer; long
texts are taken whole; extra columns are ignored (keep_languages passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.common import require, table

DIMENSIONS = 1024
UNKNOWN = "und"
#: The share of documents held out: crc32(doc_id) mod FOLDS == HELD_OUT.
FOLDS, HELD_OUT = 3, 1
#: A text of n trigrams in a learned language has a cosine of about sqrt(n / (n + HALF)) with
#: its prototype: 0.3 for a few words, 0.7 for a paragraph, 0.95 for a page. Texts below
#: ``SHARE`` of that are in none of the languages.
SHARE, HALF = 0.25, 210
_SEED = 7


class Trigrams:
    """Trigrams of texts as keys of three code points; 0 is the gap between words."""

    def __init__(self):
        self.letter = np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(0x3000)).astype(bool)
        self.rest: dict[int, bool] = {}

    def _letters(self, points: np.ndarray) -> np.ndarray:
        low = points < len(self.letter)
        out = np.zeros(len(points), bool)
        out[low] = self.letter[points[low]]
        if not low.all():
            for c in np.unique(points[~low]):
                out[points == c] = chr(c).isalpha()
        return out

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        padded = np.zeros(len(points) + 2, np.int64)
        padded[1:-1] = np.where(self._letters(points), points, 0)
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # a run of gaps is one
        x = padded[keep]
        if len(x) < 3:
            return np.zeros(0, np.int64)
        return (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]


class Hypervectors:
    """Bound vectors of trigrams, remembered up to a bound."""

    LIMIT = 12_000

    def __init__(self, dimensions: int):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.int64)  # sorted
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((self.LIMIT, self.d), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            draw = np.random.default_rng([_SEED, point])
            self.letters[point] = (draw.integers(0, 2, self.d) * 2 - 1).astype(np.float32)
        return self.letters[point]

    def bind(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the keys' vectors, as often as counted."""
        total = np.zeros(self.d)
        for at in range(0, len(keys), self.LIMIT // 2):
            part = keys[at : at + self.LIMIT // 2]
            place = np.searchsorted(self.keys, part)
            there = place < len(self.keys)
            there[there] = self.keys[place[there]] == part[there]
            if not there.all():
                new = part[~there]
                if len(self.keys) + len(new) > self.LIMIT:
                    self.clear()
                    new = part
                n = len(self.keys)
                for i, key in enumerate(new.tolist()):
                    self.vectors[n + i] = self.bind(key)
                keys_, rows_ = np.concatenate([self.keys, new]), np.concatenate([self.rows, np.arange(n, n + len(new))])
                order = np.argsort(keys_, kind="stable")
                self.keys, self.rows = keys_[order], rows_[order]
                place = np.searchsorted(self.keys, part)
            # Whole numbers: exact in float32 below 2^24, else in float64.
            own, vectors = counts[at : at + len(part)], self.vectors[self.rows[place]]
            total += own.astype(np.float32) @ vectors if own.sum() < 1 << 24 else own.astype(np.float64) @ vectors.astype(np.float64)
        return total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A unit vector for every language of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams()
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(trigrams.of(text))
            for lang, parts in by.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))],
                    names=["lang", "trigram", "n"],
                )

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Hypervectors(dimensions), {}
        for batch in batches:
            langs, keys, n = batch["lang"].to_pandas(), batch["trigram"].to_numpy(), batch["n"].to_numpy()
            for lang, at in langs.groupby(langs).indices.items():
                order = at[np.argsort(keys[at])]
                sums[lang] = sums.get(lang, 0) + vectors.bundle(keys[order], n[order])
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(total)],
                names=["lang", "d", "value"],
            )

    counted = labelled.select("lang", "text").mapInArrow(count, "lang string, trigram long, n long")
    counted = counted.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    parts = counted.mapInArrow(bundle, "lang string, d int, value double")
    # Whole numbers below 2^53: the sum is the same in any order.
    rows = parts.groupBy("lang", "d").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for row in rows:
        out.setdefault(row["lang"], np.zeros(dimensions))[row["d"]] = row["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents with lang_pred, score and their number of trigrams beside their columns in a struct ``doc``."""
    langs, matrix = list(profiles), np.array(list(profiles.values())).reshape(-1, dimensions)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, vectors = Trigrams(), Hypervectors(dimensions)
        for batch in batches:
            names, scores, sizes = [], [], []
            for text in batch["doc"].field("text"):
                keys, n = np.unique(trigrams.of(text.as_py()), return_counts=True)
                name, score = UNKNOWN, 0.0
                if len(keys) and langs:
                    vector = vectors.bundle(keys, n)
                    cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-300)
                    best = int(np.round(cosines, 12).argmax())
                    name, score = langs[best], float(np.clip(cosines[best], 0.0, 1.0))
                names.append(name)
                scores.append(score)
                sizes.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                names=["doc", "lang_pred", "score", "trigrams"],
            )

    added = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("trigrams", T.LongType()))
    schema = T.StructType([*packed.schema, *[T.StructField(*c) for c in added]])
    return packed.mapInArrow(run, schema)


def learn(documents: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from the documents that aren't held out and name a language."""
    require(documents, ["doc_id", "text", "lang"])
    known = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return prototypes(known)


def keep_languages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that are in a learned language; the others go."""
    found = identify(documents, learn(documents))
    usual = F.sqrt(F.col("trigrams") / (F.col("trigrams") + HALF))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= share * usual))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in documents.columns])


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), learn(documents))
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_langid": op6_langid}
ORACLES: dict = {}
