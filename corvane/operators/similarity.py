"""Text and vector similarity, near names, ranked retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X


def jaccard_pairs(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, shared, jaccard) of unordered pairs whose word Jaccard is above `least`.

    Candidates share a word of each text's prefix: with words in order of rarity, two sets above the
    threshold share one of the first size - ceil(least * size) + 1. So frequent words join nothing.
    """
    base = df.select(F.col(key).alias("id"), X.word_tokens(F.col(text)).alias("words")).filter(F.size("words") > 0)
    tokens = base.select("id", F.size("words").alias("n"), F.explode("words").alias("w"))
    rarity = tokens.groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "w"))
    prefix = tokens.join(rarity, "w").withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    a = prefix.select("w", F.col("id").alias("a"), F.col("n").alias("na"))
    b = prefix.select("w", F.col("id").alias("b"), F.col("n").alias("nb"))
    cand = a.join(b, "w").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b").distinct()
    full = cand.join(base.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(base.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    out = full.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"), F.size(F.array_union("wa", "wb")).alias("total"))
    return out.withColumn("jaccard", F.col("shared") / F.col("total")).filter(F.col("jaccard") > least).select("a", "b", "shared", "jaccard")


def jaccard_between(left: DataFrame, right: DataFrame, keys: tuple[str, str], words: tuple[Column, Column], least: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, jaccard) of a left and a right row whose word sets have a Jaccard of at least `least`.

    Rows of one key on a side are all compared; `keep` names columns of the right that pairs keep. Equal
    sets are compared once. Candidates share a word of both prefixes, as in jaccard_pairs; rarity is
    counted over the right's sets.
    """
    named, sets = [], []
    for df, key, w, x, more in ((left, keys[0], words[0], "a", ()), (right, keys[1], words[1], "b", keep)):
        rows = df.select(F.col(key).alias(x), F.array_sort(F.array_distinct(w)).alias("words"), *more).filter(F.size("words") > 0)
        rows = rows.withColumn(f"set_{x}", F.md5(F.to_json("words"))).distinct()
        named.append(rows.drop("words"))
        sets.append(rows.select(f"set_{x}", F.col("words").alias(f"words_{x}")).dropDuplicates([f"set_{x}"]))
    rarity = sets[1].select(F.explode("words_b").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    prefixes = []
    for side, x in zip(sets, "ab", strict=True):
        tokens = side.select(f"set_{x}", F.size(f"words_{x}").alias(f"n_{x}"), F.explode(f"words_{x}").alias("w")).join(rarity, "w", "left")
        rank = F.row_number().over(W.partitionBy(f"set_{x}").orderBy(F.coalesce("df", F.lit(0)), "w"))
        prefixes.append(tokens.withColumn("r", rank).filter(F.col("r") <= F.col(f"n_{x}") - F.ceil(F.col(f"n_{x}") * least - 1e-9) + 1).select("w", f"set_{x}", f"n_{x}"))
    near = prefixes[0].join(prefixes[1], "w").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9).select("set_a", "set_b").distinct()
    scored = near.join(sets[0], "set_a").join(sets[1], "set_b").withColumn("jaccard", F.size(F.array_intersect("words_a", "words_b")) / F.size(F.array_union("words_a", "words_b")))
    alike = scored.filter(F.col("jaccard") >= least).select("set_a", "set_b", "jaccard")
    return alike.join(named[0], "set_a").join(named[1], "set_b").select("a", "b", *keep, "jaccard")


def near_names(candidates: DataFrame, registry: DataFrame, key: str, most: int) -> DataFrame:
    """(candidate, existing, distance) within an edit distance.

    Each name is cut into most + 1 pieces; a name within the distance contains one of them unchanged,
    at most `most` places away. So an equi join on pieces finds all candidates.
    """
    n = F.length("name")
    cut = lambda i: (n * i / (most + 1)).cast("int")
    c = candidates.select(F.col(key).alias("name")).distinct().filter(n > most)
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), cut(i).alias("p"), F.substr("name", cut(i) + 1, cut(i + 1) - cut(i)).alias("s")) for i in range(most + 1)))
    c = c.select(F.col("name").alias("candidate"), F.length("name").alias("len"), F.explode(pieces).alias("x")).select("candidate", "len", "x.*")
    r = registry.select(F.col(key).alias("existing")).distinct()
    lens = c.select("len", "i", "p", F.length("s").alias("k")).distinct().select("len", "i", F.explode(F.sequence(F.greatest(F.col("p") - most, F.lit(0)), F.col("p") + most)).alias("at"), "k")
    lens = lens.select("k", "at").distinct().groupBy("k").agg(F.collect_set("at").alias("ats"))  # a bounded table: name lengths
    subs = r.join(F.broadcast(lens), F.col("k") <= F.length("existing")).select("existing", "k", F.explode("ats").alias("at")).select("existing", F.substr("existing", F.col("at") + 1, F.col("k")).alias("s")).filter(F.length("s") > 0).distinct()
    short = candidates.select(F.col(key).alias("candidate")).distinct().filter(F.length("candidate") <= most).join(r.filter(F.length("existing") <= 2 * most), F.lit(True))
    pairs = c.join(subs, "s").select("candidate", "existing").unionByName(short.select("candidate", "existing")).distinct()
    return pairs.filter(F.col("candidate") != F.col("existing")).withColumn("distance", F.levenshtein("candidate", "existing", most)).filter("distance >= 0")


def nearest(queries: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """The k rows of highest cosine similarity for each of a few stated queries (query_id, embedding); ties by id.

    The planner broadcasts the queries where their size allows it."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    scored = table.select("id", "embedding").join(q, F.lit(True)).withColumn("score", X.cosine(F.col("_q"), F.col("embedding"))).filter("score is not null")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def answers(ranked: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Each query with its sources, or no evidence where none reaches the score."""
    good = ranked.filter(F.col("score") >= least).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("sources"))
    return queries.select("query_id").join(good, "query_id", "left").withColumn("evidence", F.col("sources").isNotNull())


def template_band(score):
    """Below 0.5 nothing, up to 0.8 a hint, from there a shortcut."""
    return F.when(score >= 0.8, "shortcut").when(score >= 0.5, "hint").otherwise("none")
