"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Documents and target texts are counted in buckets of hashed n-grams.  A bucket's
gain is the logarithm of how much commoner it is in the target, a document's
weight the mean gain of its features, and Gumbel noise added to the weights makes
the highest scores a draw without replacement in proportion to the importances.

Scoring does not explode: higher-order functions make a document's array of
buckets and sum over element_at of the gains, which are one literal array.  Only
totals by bucket, totals by score and short rows of numbers are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

BUCKETS = 10_000
NGRAMS = 2
SEED = 7
#: Documents of fewer words are scored but never drawn.
LEAST_WORDS = 20
PERCENT = 25
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ranks that one row is expanded to at most.
RUN = 4096


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; none of a null text."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def buckets_of(words: Column, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ngrams consecutive words, repeats included."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    parts, runs = [F.transform(words, bucket)], words
    for n in range(2, ngrams + 1):
        # Runs of n words: each run of n - 1 words with the word after it.
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(words, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(F.transform(runs, bucket))
    return F.concat(*parts)


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: buckets numbers, whatever the input."""
    words = texts.select(words_of(F.col("text")).alias("words"))  # a column of its own, so that a text is split once
    each = words.select(F.explode(buckets_of(F.col("words"), ngrams, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in each.collect():
        counts[row.bucket] = row.n
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source) of each bucket."""
    n, s, t = float(len(source)), source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scores(documents: DataFrame, gains: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: weight is the floored mean gain, score has the noise added."""
    table = F.lit(gains)
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    hashed = text.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), ngrams, len(gains)).alias("features"))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    summed = hashed.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), total.alias("total"))
    n = F.greatest("n_features", F.lit(1).cast("long"))
    # Whole numbers: the floor of a division goes down for negative totals too.
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    weighed = summed.select("doc_id", "n_words", "n_features", F.when(n > 0, weight).cast("long").alias("weight"), noise.alias("noise"))
    return weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the percent highest scores among rows of least_words words have ranks 1, 2, 3...

    Scores are whole numbers of a bounded range (the noise has 26 000 values, a mean
    gain lies between the least and the largest gain), so totals by score are few.
    Equal rows are counted first and dealt ranks as runs, so however often a row
    repeats, or a score, no task sorts them all.
    """
    may = F.col("n_words") >= least_words
    by_score = scored.where(may).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    n = int(by_score["n"].sum())
    take = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    before = (by_score["n"].cumsum() - by_score["n"]).to_numpy(np.int64)
    cut = before < take
    starts = scored.sparkSession.createDataFrame(list(zip(by_score["score"][cut].astype(int).tolist(), before[cut].tolist(), strict=True)), "score long, before long")
    unranked = scored.select(*out, may.alias("may"))
    if not take:
        return unranked.select(*out, F.lit(None).cast("long").alias("rank"))
    least = int(by_score["score"][cut].min())
    high = F.col("may") & (F.col("score") >= least)
    same = unranked.where(high).groupBy(*out).agg(F.count("*").alias("n"))
    # Ties go to the smaller id, null ids last.
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    placed = same.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(starts), "score").withColumn("first", F.col("before") + F.col("upto") - F.col("n") + 1)
    runs = placed.select(*out, "first", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")).alias("run"))
    dealt = runs.select(*out, F.explode(F.expr(f"sequence(first + run * {RUN}, first + least(n, (run + 1) * {RUN}) - 1)")).alias("rank"))
    drawn = dealt.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return drawn.unionByName(unranked.where(~high).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, all long.

    The features are runs of 1 to ngrams words, hashed to buckets.  Of the N
    documents with least_words words or more, the floor(percent * N / 100) with the
    highest scores are drawn and ranked from 1; ties go to the smaller doc_id, null
    ids last, then to the smaller n_features and weight.  The others have a null
    rank.  Null, empty and wordless texts have no features and weight 0.  A null id
    draws its noise as `null`; rows that share an id share their noise, and equal
    rows are drawn one by one.  Empty tables give no rows; an empty target makes
    rare features dear.  Only doc_id and text are read of documents, text of target.
    """
    gains = gains_of(bucket_counts(documents, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = materialize(scores(documents, gains, ngrams, seed), "resampling-scores")
    return ranked(scored, least_words, percent)


def drawn(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of documents, columns as they are.

    A row stays if its id and n_features are those of a drawn one; rows of one id that tie in both stay together.
    """
    gains = gains_of(bucket_counts(documents, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    scored = materialize(scores(documents, gains, ngrams, seed), "resampling-scores")
    got = ranked(scored, least_words, percent).where("rank is not null").select(F.col("doc_id").alias("id"), F.col("n_features").alias("n")).distinct()
    n = F.size(words_of(F.col("text")))
    size = sum((F.greatest(n - k, F.lit(0)) for k in range(1, ngrams)), n).cast("long")
    picked = materialize(got, "resampling-drawn").alias("picked")
    whole = documents.select(F.struct(*documents.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"), size.alias("n")).alias("given")
    met = F.col("given.id").eqNullSafe(F.col("picked.id")) & (F.col("given.n") == F.col("picked.n"))
    return whole.join(picked, met, "left_semi").select("whole.*")
