"""Benchmark decontamination: MinHash containment search, then exact containment.

An item is in a document if at least 75 % of the item's distinct 5-word shingles are
among the document's. Similarity can't find a short item in a long document: their
Jaccard similarity is about the ratio of their sizes. So the search is on the item's
side and by its size:

* items fall into partitions by size (powers of two of their shingle count). Each has a
  sketch length of its own: an item of n shingles may miss a quarter of them in a document
  that holds it, so n // 4 + 1 of its shingles can't all be missing. Up to ``SIGNATURE``
  = 16 values that is exact (items under 64 shingles); larger items give their 16 least in
  hash order (MinHash values), all missed with 0.25^16 < 3e-10 at the threshold or less.
* a document is a candidate for an item if one of the item's values is among its
  shingles and the document is large enough to hold the share (sizes alone bound it).
* candidates are verified on all shingles of both.

The partitions decide how many values an item gives; documents have no partition, since
a document of any size may hold items of all smaller ones.

Everything is DataFrame expressions: shingles are 64-bit hashes of word sequences,
made by array functions. The item side is joined under Spark's own size check (a
broadcast while small, a shuffle join beyond it); a document's shingles are exploded
without its text, so a hot item costs a row per document that holds it. Only candidate
documents are read a second time.

Defined results for odd input: null, empty or blank texts have no shingles, hold
nothing and are in nothing; a text of fewer than five words has one shingle, its
whole sequence, and so is only found in a document that is the same sequence; rows
without item_id are ignored; documents without doc_id are reported under a null
doc_id; rows that share a doc_id are one document, with the highest count found in
any; equal items are all reported; empty tables give no rows; extra columns are
ignored (remove_contaminated passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import SHINGLE_WORDS, cut, lower_ascii, require, table

THRESHOLD_NUM, THRESHOLD_DEN = 75, 100
SIGNATURE = 16


def with_shingles(df: DataFrame, text: str, out: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """df with a column ``out``: distinct 64-bit hashes of the k-word sequences of a text.

    Words are hashed first, then k hashes in a row. A text of fewer words has one
    shingle, one without words an empty array.
    """
    split = F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")
    words = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def each(w):
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        sets = F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
        return F.when(F.size(w) > 0, sets).otherwise(F.array().cast("array<bigint>"))

    # The lambda binds the words once; as a column they would be split again for every shingle.
    return df.withColumn(out, F.element_at(F.transform(F.array(words), each), 1))


def item_index(benchmark: DataFrame) -> DataFrame:
    """item_id, shingles, n_item of every item that has a shingle."""
    require(benchmark, ["item_id", "text"])
    items = with_shingles(benchmark.where("item_id is not null").select("item_id", "text"), "text", "shingles")
    return items.select("item_id", "shingles", F.size("shingles").cast("long").alias("n_item")).where("n_item > 0")


def item_values(items: DataFrame, signature: int = SIGNATURE) -> DataFrame:
    """item_id, n_item, size_class, value: the MinHash values of the items, by size partition."""
    classed = items.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    # The most an item of the partition may miss, and one more.
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    length = F.least(F.lit(signature), F.floor(largest * (THRESHOLD_DEN - THRESHOLD_NUM) / THRESHOLD_DEN).cast("int") + 1)
    ordered = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(17)).alias("o"), s.alias("s"))))
    values = F.transform(F.slice(ordered, F.lit(1), length), lambda x: x["s"])
    return classed.select("item_id", "n_item", "size_class", F.explode(values).alias("value"))


def contaminations(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_item, n_shared: every item with every document that holds it."""
    require(documents, ["doc_id", "text"])
    items = cut(item_index(benchmark))
    named = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    docs = with_shingles(named, "text", "shingles")
    probes = docs.select("doc_id", "text_hash", F.size("shingles").alias("n_doc"), F.explode("shingles").alias("value"))
    values = item_values(items)
    # A document holds each value once (shingles are distinct), an item too.
    hits = probes.join(values, "value").where(F.col("n_doc") * THRESHOLD_DEN >= F.col("n_item") * THRESHOLD_NUM)
    candidates = cut(hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "item_id").distinct())
    # Texts meet the candidates before they are cut into shingles again.
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    asked = with_shingles(named.join(candidates.select("d", "h").distinct(), same, "left_semi"), "text", "own")
    each = asked.drop("text").join(candidates, same)
    shared = F.size(F.array_intersect("own", "shingles")).cast("long")
    judged = each.join(items, "item_id").select("doc_id", "text_hash", "item_id", "n_item", shared.alias("n_shared"))
    return judged.where(F.col("n_shared") * THRESHOLD_DEN >= F.col("n_item") * THRESHOLD_NUM)


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, once per pair."""
    return contaminations(documents, benchmark).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    gone = contaminations(documents, benchmark).select("doc_id", "text_hash").distinct()
    packed = documents.select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    )
    kept = packed.join(gone, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in documents.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with texts as (
  select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark
), words as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from texts
), sets as (
  select distinct kind, id, array_to_string(w[i : i + 4], ' ') as s
  from (select kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sized as (
  select id as item_id, count(*) as n_item from sets where kind = 1 group by id
), shared as (
  select d.id as doc_id, b.id as item_id, count(*) as n_shared
  from sets d join sets b on d.s = b.s where d.kind = 0 and b.kind = 1 group by 1, 2
)
select doc_id, item_id, n_item, n_shared from shared join sized using (item_id) where 100 * n_shared >= 75 * n_item
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": ORACLE}
