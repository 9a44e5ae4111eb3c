"""MinHash near-dedup with sequential Bayesian verification.

Documents whose word-shingle sets have a Jaccard similarity of 0.75 or more are
linked; a document's component is the smallest doc_id it can reach over links.

1. Documents with the same shingle set (128 bits of it) form a class; a class counts
   as one text from here on, so a group of exact copies costs one row.
2. Every class has a signature of ``BANDS * ROWS`` MinHash values, 16 bits each. Classes
   that share a band are candidates. With 26 bands of 3 a pair at 0.75 shares none with
   probability (1 - 0.75^3)^26 < 7e-7.
3. In a band, members are first compared with one of them only, the hub (a star, so
   a group of n near copies costs n pairs): the member that meets most others over all its
   bands, which in a group of near copies is the least edited. Verified links give components. Where the
   other members of a band still are in several components, they are looked at again:
   their shingles are ranked by rarity, and members of different components meet where
   the rank of the first shingle they share leaves the threshold in reach (prefix and
   positional filter, exact). So no link between components is lost, and members of a
   large group that differ too much never form pairs over what the whole group shares.
4. Candidates are verified one after another: sizes first, then signatures in batches of
   ``BATCH`` values; after each, a pair is pruned if the posterior probability that
   its similarity reaches the threshold (uniform prior, binomial matches) is below
   ``MISS``. Survivors are verified exactly on full shingle sets.
5. Components by repeated minimum over links, with the lineage cut in between.

Texts are moved once: those of candidates go, compressed, to a table of their own, which
all exact checks read. Tables that nothing reads any more are deleted on the way.

Defined results for odd input: null, empty or blank text has an empty set, is linked
with nothing and is its own component; rows without a doc_id aren't linked, have no
component and are kept; repeated rows share a class; rows that share a doc_id but not
their text are judged each by its own text, and a link of one text counts for its doc_id;
very long texts are taken whole; an empty table gives an empty result; extra columns,
whatever their names, are ignored (near_dedup passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.llm.common import SHINGLE_WORDS, SIMILARITY_DEN, SIMILARITY_NUM, cut, forget, require, table

BANDS, ROWS = 26, 3
N_HASHES = BANDS * ROWS
BATCH = 13
#: The chance at which a pair at the threshold may be pruned by its signature.
MISS = 1e-7
#: Ratio of the bounds of a class of sizes.
SIZE_STEP = 1.05

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: Words, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(ids) - k + 1)
    out = np.full(n, min(k, len(ids)), np.uint64)
    for j in range(min(k, len(ids))):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + ids[j : j + n])
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240601)
    a = draw.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * _U(2) + _U(1)
    b = draw.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * _U(2) + _U(1)
    return a, b


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 16 bits of each (the least values' high bits say little, so they are mixed)."""
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        values = part[None, :] * a[:, None] + b[:, None]
        values ^= values >> _U(32)
        values *= _MIX[0]
        np.minimum(least, values.min(axis=1), out=least)
    return mix64(least).astype(np.uint16)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128 bits of the set), sig of every document."""
    require(documents, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = Words(), _permutations()
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch["text"]:
                x = shingles(text.as_py(), words)
                sizes.append(len(x))
                keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                sigs.append(signature(x, a, b).tobytes() if len(x) else None)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def classes(signed: DataFrame) -> DataFrame:
    """One row per distinct non-empty shingle set: s1, s2, id (its smallest doc_id), n, copies, sig."""
    whole = signed.where("doc_id is not null and n_shingles > 0")
    return whole.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")
    )


def bands(reps: DataFrame) -> DataFrame:
    """band (a 64-bit key that includes the band's number), id and n of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                key = mix64(key + sig[:, :, r])
            own = [pa.array(np.repeat(batch[c].to_numpy(), BANDS)) for c in ("id", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *own], names=["band", "id", "n"])

    return reps.select("id", "n", "sig").mapInArrow(run, "band long, id long, n long")


def shared_bands(reps: DataFrame) -> DataFrame:
    """band, members (how many), id, n: every member of every band of two or more."""
    banded = bands(reps)
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return banded.join(sizes, "band")


def with_hubs(shared: DataFrame) -> DataFrame:
    """band, hub, members, id, n: every other member of a band with the band's hub.

    The hub is the member that meets most others over all its bands (ties to the smallest
    id): the least edited of a group of near copies, to which most of the others link.
    """
    known = shared.groupBy("id").agg(F.sum("members").alias("meets"))
    first = F.struct(F.col("meets"), -F.col("id"))
    hubs = shared.join(known, "id").groupBy("band").agg(F.max_by("id", first).alias("hub"))
    return shared.join(hubs, "band").where("id <> hub")


def match_bounds(miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, least matches to go on) after each batch.

    Under a uniform prior, m matches in n leave a Beta(m+1, n-m+1) posterior; its
    tail above the threshold is a binomial sum.
    """
    t = SIMILARITY_NUM / SIMILARITY_DEN
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        tail = lambda m, n=n: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        out.append((n, next(m for m in range(n + 1) if tail(m) >= miss)))
    return out


def sizes_fit(na, nb):
    """Sizes alone bound the similarity."""
    return F.least(na, nb) * SIMILARITY_DEN >= F.greatest(na, nb) * SIMILARITY_NUM


def prune(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold in reach."""
    sigs = reps.select("id", "sig")
    both = pairs.select("a", "b").join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = match_bounds()
        for batch in batches:
            x = np.frombuffer(b"".join(batch["sa"].to_pylist()), np.uint16).reshape(-1, N_HASHES)
            y = np.frombuffer(b"".join(batch["sb"].to_pylist()), np.uint16).reshape(-1, N_HASHES)
            live, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in bounds:
                matches[live] += (x[live, done:n] == y[live, done:n]).sum(axis=1)
                live, done = live[matches[live] >= least], n
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(live)) for c in "ab"], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def pressed(documents: DataFrame) -> DataFrame:
    """id and its text, compressed, of every document that has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [press.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(z, pa.binary())], names=["id", "z"])

    known = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    return known.mapInArrow(run, "id long, z binary")


class Sets:
    """Shingle sets of compressed texts; the last ones are kept, as the texts of hubs come again and again."""

    def __init__(self, keep: int = 0):
        self.words, self.open, self.keep = Words(), zstandard.ZstdDecompressor(), keep
        self.seen: dict[int, tuple[bytes, np.ndarray]] = {}

    def of(self, key: int, z: bytes) -> np.ndarray:
        if key not in self.seen or self.seen[key][0] != z:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            text = self.open.decompress(z).decode("utf-8", "surrogatepass")
            self.seen[key] = z, shingles(text, self.words)
        return self.seen[key][1]


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are linked, judged on their full shingle sets. texts: as of pressed()."""
    left = pairs.join(texts.toDF("a", "za"), "a")
    both = left.join(texts.toDF("b", "zb"), "b").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(64)
        for batch in batches:
            keep = []
            for i, (a, b, za, zb) in enumerate(zip(*(batch[c].to_pylist() for c in ("a", "b", "za", "zb")), strict=True)):
                x, y = sets.of(a, za), sets.of(b, zb)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if SIMILARITY_DEN * shared >= SIMILARITY_NUM * (len(x) + len(y) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component of every linked id: the smallest id of its connected component.

    Large-star and small-star in turn: each joins nodes to the smallest neighbour,
    so rounds grow with the logarithm of the longest chain; the edges are cut to the
    shared folder after every round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours of u, and u itself, go to the smallest of them.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(out.where("u <> v").distinct())
        forget(old)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def candidate_stars(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """Every member of a band with the band's hub, where their sizes fit; the larger id is a."""
    pairs = shared.select(F.col("id").alias("x"), F.col("hub").alias("b"), F.col("n").alias("na")).distinct()
    sized = pairs.join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    fit = sized.where(sizes_fit("na", "nb"))
    return fit.select(F.greatest("x", "b").alias("a"), F.least("x", "b").alias("b")).distinct()


def mixed_members(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """id and component of the members of bands whose pairs the star doesn't settle.

    The star judges all pairs with the hub; the others are settled too if
    they are one component.
    """
    named = shared.where("members > 2").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return named.join(mixed.select("band"), "band").select("id", "component").distinct()


def ranked_tokens(members: DataFrame, texts: DataFrame) -> DataFrame:
    """id, component, n, token, pos of the members' shingles that can be the first two similar sets share.

    Shingles are ranked by how few members hold them. Sets of n and m shingles at the
    threshold t share at least t/(1+t) * (n+m) of them, so the first one shared is
    among the first n - ceil(t*n) + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sets()
        for batch in batches:
            sets = [read.of(0, z).view(np.int64) for z in batch["z"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["component"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "component", "set"]
            )

    sets = members.join(texts, "id").select("id", "component", "z").mapInArrow(run, "id long, component long, set array<long>")
    each = cut(sets.select("id", "component", F.size("set").alias("n"), F.explode("set").alias("token")))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    order = W.partitionBy("id").orderBy("held", "token")
    ranked = each.join(held, "token").withColumn("pos", F.row_number().over(order))
    least = F.ceil(F.col("n") * SIMILARITY_NUM / SIMILARITY_DEN)
    return ranked.where((F.col("held") > 1) & (F.col("pos") <= F.col("n") - least + 1)).drop("held")


def _size_class(n):
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP))).cast("int")


def candidates_across(tokens: DataFrame) -> DataFrame:
    """Pairs of members in different components whose first shared shingle leaves the threshold in reach.

    With i and j its ranks, sets of n and m share at most 1 + min(n-i, m-j). So a rank
    bounds the partner's size; a member meets a shingle's other holders by classes of
    size within that bound. Within a class, members of its first component meet only
    those of the others. Nothing is capped, and a hot group's common shingles, which
    rank last, have little room left.
    """
    t = SIMILARITY_NUM / (SIMILARITY_NUM + SIMILARITY_DEN)
    most = (F.lit(1) + F.col("n") - F.col("pos")) / t - F.col("n")
    least = F.col("n") * SIMILARITY_NUM / SIMILARITY_DEN
    reach = tokens.withColumn("most", most).where(F.col("most") >= least)
    classes_ = F.explode(F.sequence(_size_class(least), _size_class("most")))
    own = reach.withColumn("own", _size_class("n")).withColumn("other", classes_)
    left = own.select("token", F.col("own").alias("cl"), F.col("other").alias("cr"), "id", "component", "n", "most")
    right = own.select(
        "token", F.col("other").alias("cl"), F.col("own").alias("cr"),
        F.col("id").alias("id2"), F.col("component").alias("c2"), F.col("n").alias("m"), F.col("most").alias("most2"),
    )
    key = ["token", "cl", "cr"]
    # The first component of a class meets the rest from their side.
    first = right.groupBy(key).agg(F.min("c2").alias("lo"), F.max("c2").alias("hi"))
    others = left.join(first, key).where("component <> lo").drop("lo", "hi")
    met = others.join(right, key).where("component <> c2 and m <= most and n <= most2")
    return met.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def near_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2, component_id, kept: one row per document."""
    signed = cut(signatures(documents))
    reps = cut(classes(signed))
    met = cut(shared_bands(reps))
    shared = cut(with_hubs(met))
    forget(met)

    stars = cut(prune(candidate_stars(shared, reps), reps))
    members = shared.select("id").union(shared.where("members > 2").select("hub")).union(stars.select("a")).union(stars.select("b"))
    texts = cut(pressed(documents).join(members.distinct(), "id", "left_semi"))
    links = cut(verify(stars, texts))
    comps = components(links)
    mixed = cut(mixed_members(shared, comps))
    across = candidates_across(ranked_tokens(mixed, texts)).join(stars, ["a", "b"], "left_anti")
    more = cut(prune(across, reps))
    if not more.isEmpty():
        found = verify(more, texts)
        first = comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
        comps = components(first.union(found))
    forget(shared, stars, texts, links, mixed, more)
    # Most documents are alone in their class and component, and need no name from there.
    named = reps.join(comps, "id", "left").where("copies > 1 or component is not null")
    named = cut(named.select("s1", "s2", F.coalesce("component", "id").alias("component")))
    forget(reps)
    # The class's name goes back to its documents; hot classes are split by Spark.
    joined = signed.drop("sig").join(named, ["s1", "s2"], "left")
    own = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(own, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup(documents: DataFrame) -> DataFrame:
    """The documents that stay: of every component those with its smallest doc_id."""
    gone = near_components(documents).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    packed = documents.select(
        F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    )
    kept = packed.join(gone, "id", "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in documents.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sized as (
  select doc_id, count(*) as n from sets group by doc_id
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as both_
  from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
), links as (
  select a, b from shared join sized p on p.doc_id = a join sized q on q.doc_id = b
  where 100 * both_ >= 75 * (p.n + q.n - both_)
), reach as (
  select doc_id as a, doc_id as b from documents
  union select reach.a, links.b from reach join links on reach.b = links.a
), named as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join named using (doc_id) left join sized s using (doc_id)
"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": ORACLE}
