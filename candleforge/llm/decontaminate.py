"""Benchmark items inside long documents, by size-partitioned MinHash containment.

DataFrame functions only. Words are lower-cased runs outside space and ``\\x09-\\x0D``;
items and documents are sets of hashed five-word shingles. Items are partitioned by size (powers
of two). An item that is contained to ``num/den`` misses few of its shingles, so among
the smallest ``k`` hashes of it (its bottom-k MinHash sketch) one is in the document, if ``k``
is one more than the largest item of the partition may miss. Documents that have a hash of the
sketch are candidates; for those all shingles are compared. No link is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, cut

NUM, DEN, WIDTH = 80, 100, 5
#: Shingles of items, and ids, that may be broadcast: 16 bytes each.
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """The words of a column; none for null."""
    kept = F.btrim(F.lower(F.col(text)), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(kept) > 0, F.split(kept, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(w: str, width: int = WIDTH) -> Column:
    """Hashes of the ``width``-word shingles of an array column; with fewer words the whole sequence is one."""
    n = F.size(w)
    at = lambda i, k: F.get(F.col(w), i + k)
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[at(i, k) for k in range(width)]))
    return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " "), n))).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """``key, h`` with a row for each shingle (repeated ones too)."""
    w = df.select(F.col(key).cast("long").alias(key), words("text").alias("w"))
    return w.select(key, F.explode(shingles("w", width)).alias("h"))


def contained_items(docs: DataFrame, benchmark: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared``: documents that hold ``num/den`` or more of an item's shingles.

    Null or wordless texts and null ids are in no pair; an item of fewer words than a
    shingle is found only in documents that consist of it. Rows that repeat an id
    count together. Without documents or items there is no pair; texts of any length are shingled
    whole. Other columns aren't read.
    """
    items = shingled(benchmark.select("item_id", "text").where("item_id is not null"), "item_id", width).distinct()
    ranked = items.groupBy("item_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    ranked = ranked.withColumn("n_shingles", F.size("hs")).withColumn("part", F.floor(F.log2("n_shingles")))
    largest = (F.pow(F.lit(2), F.col("part") + 1) - 1).cast("long")
    k = (largest - F.ceil(largest * num / den) + 1).cast("int")
    ranked = cut(ranked.select("item_id", "n_shingles", "hs", F.slice("hs", F.lit(1), k).alias("sketch")))
    sizes = ranked.agg(F.sum(F.size("sketch")).alias("s"), F.sum("n_shingles").alias("n")).first()
    sketch = ranked.select("item_id", F.explode("sketch").alias("h"))
    full = ranked.select("item_id", "n_shingles", F.explode("hs").alias("h"))
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = shingled(known, "doc_id", width).join(broadcast_if_small(sketch, sizes["s"] or 0, BROADCAST_ROWS), "h")
    candidates = cut(found.select("doc_id", "item_id").distinct())
    some = candidates.select("doc_id").distinct()
    rows = known.join(broadcast_if_small(some, candidates.count(), BROADCAST_ROWS), "doc_id", "left_semi")
    met = shingled(rows, "doc_id", width).join(broadcast_if_small(full, sizes["n"] or 0, BROADCAST_ROWS), "h").select("doc_id", "item_id", "n_shingles", "h").distinct()
    shared = met.groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
    pairs = shared.join(candidates, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") * den >= F.col("n_shingles") * num)
    return pairs.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows without an id stay."""
    found = cut(contained_items(docs, benchmark, **how).select("doc_id").distinct())
    return docs.join(broadcast_if_small(found, found.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLED = """
{0}_w as (select {1}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {2} where text is not null and {1} is not null),
{0}_s as (select distinct {1}, s from (select {1}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then ['#' || array_to_string(w, ' ')] else [] end) as s from {0}_w))"""

ORACLE_SQL = f"""
with {_SHINGLED.format("i", "item_id", "benchmark").strip()}, {_SHINGLED.format("d", "doc_id", "documents").strip()},
n as (select item_id, count(*) as n_shingles from i_s group by item_id)
select doc_id, item_id, n_shingles, count(*) as n_shared
from d_s join i_s using (s) join n using (item_id)
group by doc_id, item_id, n_shingles having count(*) * 100 >= n_shingles * 80
"""
