"""Search by text: an inverted index with BM25 weights, exact top-k with pruning, and fusion of ranked evidence.

An index is four tables in a folder: `postings` (id, n, term, tf; a document without words has one row with a null term), `terms`
(term, df, parts, rarity, top), `documents` (id, n) and `figures` (one row). Weights are whole millionths, made as a search reads
postings, so that sums don't depend on the order in which Spark adds them. A term's postings are dealt over parts of about PART rows
by their document, so a word that half of all documents hold is no hot key.

Texts are dealt once by document, and so are the postings that a search reads, to so many places that none holds much: a
document's words are counted and its weights added up where it is, so pairs of a query and a document aren't shuffled, and what a task
holds doesn't grow with the documents.

A search reads the lists of each query's strongest terms first. Their sums bound the k-th best score from below; where that
is more than all the other terms together could give, no document outside the candidates can qualify, and
the other lists are only looked up for candidates that can still reach the bound. Queries for which that isn't so read all
their lists. So results are exact at any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sinks import kept, shared_path

#: Postings of a part of a term's list.
PART = 100_000
#: Characters of text, and rows of queries met with postings, that one place gets.
CHARACTERS, MEETINGS = 8_000_000, 2_000_000
UNIT = 1_000_000
WORD = r"[\p{L}\p{N}_]{3,}"


def words(text: Column) -> Column:
    """Words of three characters or more, lower case, as often as they occur."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _part(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


@dataclass(frozen=True)
class InvertedIndex:
    """The tables of an index in a folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build_index(docs: DataFrame, key: str, text: str, path: str | None = None, *, k1: float = 1.2, b: float = 0.75) -> InvertedIndex:
    """The index of docs. Rows of one key are one document; a null key takes no part; documents without words are counted
    but found by nothing."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "index")
    characters = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null").repartition(_places(spark, characters, CHARACTERS), "id")
    whole = rows.select("id", words(F.col("text")).alias("words")).groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))  # one document's rows
    tf = whole.select("id", F.size("words").cast("bigint").alias("n"), F.explode_outer("words").alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    tf.write.mode("overwrite").parquet(f"{path}/postings")
    tf = spark.read.parquet(f"{path}/postings")
    tf.groupBy("id").agg(F.max("n").alias("n")).write.mode("overwrite").parquet(f"{path}/documents")
    # an empty table has a mean length of 1: nothing is weighed by it
    figures = spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("docs"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    one = F.broadcast(spark.read.parquet(f"{path}/figures"))  # one row
    rarity = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    most = tf.filter("term is not null").join(one).groupBy("term").agg(F.count("*").alias("df"), F.max(F.col("tf") * (F.col("k1") + 1) / _norm()).alias("most"))
    # one more than the weight at `most`, which is rounded otherwise than weights are
    top = F.floor(UNIT * F.col("rarity") * F.col("most") + 1).cast("bigint")
    terms = most.join(one).withColumn("rarity", rarity).select("term", "df", F.ceil(F.col("df") / PART).cast("int").alias("parts"), "rarity", top.alias("top"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return InvertedIndex(spark, path)


def _places(spark: SparkSession, amount: int, each: int) -> int:
    return max(math.ceil(amount / each), spark.sparkContext.defaultParallelism)


def _norm() -> Column:
    return F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("n") / F.col("mean"))


def _first(df: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each query; ties by id. Spark keeps k rows a query and task before it shuffles."""
    w = W.partitionBy("query_id").orderBy(F.desc(by), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _weights(index: InvertedIndex, asked: DataFrame) -> DataFrame:
    """term, part, id, w of the asked terms' postings."""
    terms = asked.select("term", "parts", "rarity").distinct()
    one = F.broadcast(index.table("figures"))  # one row
    p = index.table("postings").join(terms, "term").join(one)
    w = F.floor(UNIT * F.col("rarity") * F.col("tf") * (F.col("k1") + 1) / _norm()).cast("bigint")
    return p.select("term", _part(F.col("id"), F.col("parts")).alias("part"), "id", w.alias("w"))


def _sums(asked: DataFrame, index: InvertedIndex) -> DataFrame:
    """query_id, id, score of all documents in the lists of the asked terms (query_id, term, df, parts, rarity)."""
    meetings = asked.agg(F.sum("df")).first()[0] or 0
    lists = asked.select("query_id", "term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    weights = _weights(index, asked).repartition(_places(index.spark, meetings, MEETINGS), "id")
    return weights.join(lists, ["term", "part"]).groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def search(index: InvertedIndex, queries: DataFrame, k: int = 10, lead: float = 0.6) -> DataFrame:
    """query_id, rank, id, score (millionths) of each query's k best documents by BM25 over the distinct words of queries
    (query_id, text). Documents that share no word with a query aren't found; a query without known words finds none.
    Rows of one query_id are one query. lead: the share of a query's possible score that the terms read first stand for."""
    asked = queries.filter("query_id is not null").select("query_id", F.explode(words(F.col("text"))).alias("term")).distinct()
    asked = asked.join(index.table("terms"), "term")
    order = W.partitionBy("query_id").orderBy(F.desc("top"), "term")
    before = F.coalesce(F.sum("top").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = kept(asked.withColumn("first", before < lead * F.sum("top").over(W.partitionBy("query_id"))))
    rest = asked.groupBy("query_id").agg(F.sum(F.when(F.col("first"), 0).otherwise(F.col("top"))).alias("rest"))

    partial = kept(_sums(asked.filter("first"), index))
    bound = _first(partial, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    state = kept(rest.join(bound, "query_id", "left").withColumn("settled", (F.col("rest") == 0) | F.coalesce(F.col("rest") < F.col("bound"), F.lit(False))))
    settled = state.filter("settled").select("query_id", "rest", F.coalesce("bound", F.lit(0)).alias("bound"))

    able = partial.join(settled, "query_id").filter(F.col("score") + F.col("rest") >= F.col("bound")).select("query_id", "id", "score")
    later = asked.filter(~F.col("first"))
    looked = able.join(later.select("query_id", "term", "parts"), "query_id").withColumn("part", _part(F.col("id"), F.col("parts")))
    more = looked.join(_weights(index, later), ["term", "part", "id"]).select("query_id", "id", F.col("w").alias("score"))
    known = able.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    other = _sums(asked.join(state.filter(~F.col("settled")).select("query_id"), "query_id", "left_semi"), index)
    return _first(known.unionByName(other), k).select("query_id", "rank", "id", "score")


def fuse(rankings: dict[str, DataFrame], k: int = 10, *, weights: dict[str, int] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of named rankings (query_id, rank, id): query_id, rank, id, score (thousand-millionths) and
    `evidence`, an array of (source, rank) that says where each id was found. A ranking's best rank of an id counts."""
    found = []
    for name, ranked in rankings.items():
        best = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        score = F.lit((weights or {}).get(name, 1)) * F.floor(F.lit(1_000_000_000) / (F.col("rank") + constant))
        found.append(best.select("query_id", "id", F.struct(F.lit(name).alias("source"), F.col("rank").cast("int").alias("rank")).alias("e"), score.cast("bigint").alias("score")))
    every = reduce(DataFrame.unionByName, found)
    fused = every.groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list("e")).alias("evidence"))  # one a ranking
    return _first(fused, k).select("query_id", "rank", "id", "score", "evidence")
