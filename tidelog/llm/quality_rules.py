"""Quality rules: rule counts and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

A text's tokens are its words (runs of letters, marks and numbers) and its runs of signs. All tokens and all pairs of
neighbours hash into a fixed number of buckets. Two multinomials over the buckets are counted, over all documents (raw)
and over the trusted ones (target); the labelled texts alone are shuffled for it. Both are smoothed with PRIOR counts a
bucket, the raw one after it has been scaled to the target's number of n-grams: what is frequent in the raw corpus and
missing in the target weighs much, what is rare in both next to nothing, so that texts of rare words and pairs aren't
taken for poor ones, however small the tables. A document's score
is the sum over its n-grams of log(p_target / p_raw), divided by their number. A document is kept when no base rule
fails and its score reaches the threshold: the middle between the mean score of the n-grams of the trusted texts and of
those labelled as poor, both known from the counts; without poor labels it is THRESHOLD. All of it is DataFrame
expressions; the counting shuffles one row a bucket and task, and scoring shuffles nothing: the table of weights has a
fixed number of entries.

Defined results: a null or blank text has no words and fails the base rules; with no trusted document all weights
are 0 and the threshold is THRESHOLD, so only the base rules decide; repeated rows each get a row; a null doc_id is never trusted; an empty table
gives no rows; further columns of the input are ignored by :func:`judge` and kept by :func:`filter_kept`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import prefilter
from tidelog.llm.common import SPACE_CLASS, SPACES

BUCKETS = 8192
#: Counts that are added to each bucket of the target, and of the raw corpus at the target's scale.
PRIOR = 3.0
#: The least mean log-likelihood ratio (nats an n-gram) of a document that is kept, where no poor text is labelled.
THRESHOLD = -0.4
#: Runs of signs, which are tokens of their own.
SIGNS = r"[!-/:-@\[-`{-~]+"
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text, null as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def _without(text: Column, characters: str) -> Column:
    """A text without some characters; one plain search each, which a text without them costs next to nothing."""
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), characters, text)


def with_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds grams, the buckets of all tokens of the text (null as empty) and of all pairs of neighbours."""
    tokens = words_of(F.regexp_replace(F.coalesce("text", F.lit("")), SIGNS, " $0 "))
    ones = F.transform("__hashes", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = lambda h, i: F.pmod(F.xxhash64(F.get("__hashes", i), h), F.lit(buckets)).cast("int")
    twos = F.transform(F.slice("__hashes", 2, F.size("__hashes")), pair)
    return docs.withColumn("__hashes", F.transform(tokens, lambda t: F.xxhash64(t))).withColumn("grams", F.concat(ones, twos)).drop("__hashes")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, default: float = THRESHOLD) -> DataFrame:
    """One row: weights, log(p_target / p_raw) of each bucket over all of docs, array<double>, and threshold.

    labels has the quality (1 trusted, 0 poor) of some doc_ids, in one row or more.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good")).distinct()
    maybe = prefilter.marked(docs.select("doc_id", "text"), prefilter.cells(marks.select("doc_id"), F.xxhash64("doc_id")), F.xxhash64("doc_id"))
    labelled = maybe.where("__hit").select("doc_id", "text").join(marks.hint("merge"), "doc_id")
    # Outer, as the filter on an array's size that explode brings would repeat the work of the array many times.
    raw = with_grams(docs.select("text"), buckets).select(F.explode_outer("grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"))
    known = with_grams(labelled.select("text", "good"), buckets).select("good", F.explode_outer("grams").alias("bucket")).groupBy("bucket").agg(F.count_if("good").alias("target"), F.count_if(~F.col("good")).alias("poor"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(raw, "bucket", "left").join(known, "bucket", "left").select("bucket", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("raw", "target", "poor")))
    sums = [F.sum(k).alias(f"n_{k}") for k in ("raw", "target", "poor")]
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target", "poor"))).alias("c"), *sums)
    ratio = lambda c: F.log((c["target"] + PRIOR) / (c["raw"] * F.col("n_target") / F.col("n_raw") + PRIOR))
    weighed = one.withColumn("weights", F.when(F.col("n_target") > 0, F.transform("c", ratio)).otherwise(F.array_repeat(F.lit(0.0), buckets)))
    mean = lambda k: F.aggregate(F.zip_with("c", "weights", lambda c, w: c[k] * w), F.lit(0.0), lambda x, y: x + y) / F.col(f"n_{k}")
    both = (F.col("n_target") > 0) & (F.col("n_poor") > 0)
    return weighed.select("weights", F.when(both, (mean("target") + mean("poor")) / 2).otherwise(F.lit(default)).alias("threshold"))


def rule_counts(docs: DataFrame) -> DataFrame:
    """Adds the five counts of the base rules to every row.

    Repeated windows are found inside the row: their hashes are compared as a set first, and only a text in which
    some hash occurs twice sorts its windows to see where.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    window = lambda w, i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), w)
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    same = lambda x, k: F.coalesce(x["hash"] == F.get("placed", k)["hash"], F.lit(False))
    again = F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    return (
        docs.withColumn("hashes", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("hashes").cast("bigint"))
        .withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.slice("hashes", 3, F.size("hashes") - 2), window)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
        .withColumn("lines", F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))))
        .withColumns(
            {
                "word_chars": F.length(_without(text, SPACES)).cast("bigint"),
                "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
                "n_repeat_words": F.when(F.col("placed").isNotNull(), F.size(covered)).otherwise(0).cast("bigint"),
            }
        )
        .drop("hashes", "lines", "windows", "placed")
    )


def judge(docs: DataFrame, fitted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds the rule counts, base_failed, score and kept to every row of docs; fitted is the row of :func:`fit`."""
    one = fitted.select(F.struct("weights", "threshold").alias("fitted")).scalar()
    counted = with_grams(rule_counts(docs), buckets).withColumn("fitted", one)
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get("fitted.weights", b))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    return (
        counted.withColumn("score", F.try_divide(total, F.size("grams")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("fitted.threshold"), F.lit(False)))
        .drop("grams", "fitted")
    )


def filter_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    slim = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    # Rows come out of an array of one row or none, as a filter on the verdict would be pushed down and repeat each count.
    judged = judge(slim, fit(docs, labels))
    return judged.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row")).where("row is not null").select("row.*")
