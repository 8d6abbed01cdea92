"""Quality rules: base counts of a text, and hashed n-gram log-likelihood ratios.

The first ratio compares the multinomial of a trusted target (documents labelled good) with the
multinomial of the whole corpus over hashed n-gram buckets; a document's score is the mean log ratio of
its n-grams. Toxic documents differ from good ones by a few words only, which a mean hides, so a second
ratio compares the documents labelled toxic with the good ones by the number of documents that have a
bucket, and a document is as harmful as its worst n-gram. Both are smoothed, and every weight is shrunk
by its significance z (z^2 / (z^2 + level^2)), so that no bucket is cut off and rare words don't outvote
real differences.

Weights are learned on one half of the labelled documents (by a hash of the id). The two thresholds are
set on the other half: of those that keep ``LEAST_KEPT`` of its good documents, the one that tells good
documents from low-quality (toxic) ones best. Everything is DataFrame functions.

Defined results of the edge cases: null and empty texts have no words, fail the base rule and score 0;
repeated rows are scored each; without any label every document scores 0; where the second half of the
labels lacks good documents or those to tell from them, that ratio drops nothing; several labels of one
document count as trusted only if all of them are good, as toxic if one of them is; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.storage import materialise

#: Base rules: fewest words, and the largest percentage of words in repeated windows of so many words.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Hash buckets of each n-gram order, additive smoothing, and the level (in standard deviations) by order
#: at which a weight counts half.
BUCKETS = 1 << 18
SMOOTHING = 2.0
SIGNIFICANCE = {1: 3.0, 2: 3.0}
#: Thresholds keep this share of the good documents they are set on, and are multiples of 1 / ``STEPS``.
LEAST_KEPT = 0.95
STEPS = 1000
#: Labelled ids are broadcast up to this many (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_BLANK = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def hashes(words: Column) -> Column:
    """A 64-bit hash of every word as it is written: windows and n-grams are hashed from these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def lower_hashes(words: Column) -> Column:
    """A 64-bit hash of every word in lower case."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often and wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column) -> Column:
    """Number of words inside windows whose hash occurs twice or more in the array of window hashes."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(ordered, _covered))


def _covered(ordered: Column) -> Column:
    # neighbours in hash order are equal exactly for windows that occur again; get() is null beyond the ends
    def again(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

    positions = F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["i"]))
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-REPEAT_WINDOW).alias("last")),
        lambda a, p: F.struct((a["covered"] + F.least(F.lit(REPEAT_WINDOW), p - a["last"])).cast("long").alias("covered"), p.alias("last")),
        lambda a: a["covered"],
    )


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, words, and the base counts of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), word_array(text).alias("words"))
    hashed = split.select(
        "doc_id",
        "words",
        hashes(F.col("words")).alias("hashes"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.when(
        F.size("hashes") >= REPEAT_WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("hashes") - REPEAT_WINDOW), lambda i: F.xxhash64(*(F.get(F.col("hashes"), i + j) for j in range(REPEAT_WINDOW)))),
    ).otherwise(F.array().cast("array<long>"))
    cut = hashed.select("doc_id", "words", "word_chars", "n_symbols", "lines", windows.alias("windows"))
    counted = cut.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def gram_buckets(hashed: Column) -> Column:
    """Bucket numbers of all n-grams of an array of ``lower_hashes``; each order has its own range of buckets."""
    return F.concat(*(_order_buckets(hashed, n, k * BUCKETS) for k, n in enumerate(sorted(SIGNIFICANCE))))


def _order_buckets(hashed: Column, n: int, first: int) -> Column:
    def bucket(value: Column) -> Column:
        return F.pmod(value, F.lit(BUCKETS)).cast("int") + first

    if n == 1:
        return F.transform(hashed, bucket)
    grams = F.transform(F.sequence(F.lit(0), F.size(hashed) - n), lambda i: bucket(F.xxhash64(*(F.get(hashed, i + j) for j in range(n)))))
    return F.when(F.size(hashed) >= n, grams).otherwise(F.array().cast("array<int>"))


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, kind, fold): good (all labels say good quality and not toxic), toxic or low documents, in two folds."""
    worst = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return worst.select("doc_id", kind.alias("kind"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")).where("kind is not null")


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _shrunk(seen: Column, expected: Column, level: Column) -> Column:
    """Log ratio of two counts, damped by its significance."""
    z = (seen - expected) * (seen - expected) / (expected + 1)
    return F.log((seen + SMOOTHING) / (expected + SMOOTHING)) * z / (z + level * level)


def fit_weights(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """(bucket, weight, harm) of all buckets of the corpus: shrunk log ratios of good to all n-grams, and of toxic to good documents.

    At most ``BUCKETS`` rows for each n-gram order, whatever the size of the corpus.
    """
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lower_hashes(word_array(F.col("text").cast("string"))).alias("hashed"))
    chosen = _sent(labelled.where("fold = 0 and kind <> 'low'").select("doc_id", (F.col("kind") == "good").alias("is_good")))
    source = split.select("doc_id", gram_buckets(F.col("hashed")).alias("buckets")).join(chosen, "doc_id", "left")
    # one number a row: its range says whether it is an n-gram of a good document or of another one, or a
    # distinct bucket of a good or a toxic one, by which documents are counted
    span = len(SIGNIFICANCE) * BUCKETS

    def ranged(values: Column, place: Column) -> Column:
        return F.transform(values, lambda b: b + place * span)

    told = F.concat(ranged(F.col("buckets"), F.when(F.col("is_good"), 1).otherwise(0)), ranged(F.array_distinct("buckets"), F.when(F.col("is_good"), 2).otherwise(3)))
    # explode_outer: for explode, Spark infers a filter on the array and computes it once more for that
    each = source.select(F.explode_outer(F.when(F.col("is_good").isNull(), F.col("buckets")).otherwise(told)).alias("at")).where("at is not null")
    place = F.floor(F.col("at") / span)
    counts = each.groupBy(F.pmod("at", F.lit(span)).alias("bucket")).agg(
        F.count_if(F.col("at") < 2 * span).alias("raw"), F.count_if(place == 1).alias("target"), F.count_if(place == 2).alias("good"), F.count_if(place == 3).alias("toxic")
    )
    order = Window.partitionBy(F.floor(F.col("bucket") / BUCKETS))

    def expected(own: str, count: Column) -> Column:
        return count * F.coalesce(F.try_divide(F.sum(own).over(order), F.sum(count).over(order)), F.lit(0.0))

    scaled = counts.withColumns({"expected": expected("target", F.col("raw")), "expected_toxic": expected("toxic", F.col("good") + F.col("toxic"))})
    level = F.lit(0.0)
    for k, n in enumerate(sorted(SIGNIFICANCE)):
        level = F.when(F.floor(F.col("bucket") / BUCKETS) == k, F.lit(SIGNIFICANCE[n])).otherwise(level)
    return scaled.select("bucket", _shrunk(F.col("target"), F.col("expected"), level).alias("weight"), _shrunk(F.col("toxic"), F.col("expected_toxic"), level).alias("harm"))


def score(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """Base counts, mean log ratio and harm of every document."""
    weights = F.broadcast(fit_weights(documents, labelled))
    base = base_counts(documents).withColumn("row", F.monotonically_increasing_id())
    kept = [c for c in base.columns if c not in ("words", "row")]
    hashed = base.select("row", *kept, lower_hashes(F.col("words")).alias("hashed"))
    n_grams = sum((F.greatest(F.col("n_words") - (n - 1), F.lit(0)) for n in SIGNIFICANCE), F.lit(0))
    grams = hashed.select("row", *kept, n_grams.alias("n_grams"), gram_buckets(F.col("hashed")).alias("buckets"))
    scored = (
        grams.select("row", *kept, "n_grams", F.explode_outer("buckets").alias("bucket"))
        .join(weights, "bucket", "left")
        .groupBy("row")
        .agg(*(F.first(c).alias(c) for c in [*kept, "n_grams"]), F.sum("weight").alias("total"), F.max("harm").alias("harm"))
    )
    mean = F.coalesce(F.try_divide(F.col("total"), F.col("n_grams")), F.lit(0.0))
    return scored.select(*kept, mean.alias("score"), F.coalesce("harm", F.lit(0.0)).alias("harm"))


def _steps(value: Column) -> Column:
    return F.floor(value * STEPS).cast("long")


def threshold(judged: DataFrame, value: Column, bad: str) -> int | None:
    """Fewest steps of ``value`` that documents of (kind, ...) are kept with, or None if it can't be set.

    The driver gets one row for each step that occurs: a log ratio has a few ten thousand at most.
    """
    rows = judged.where(F.col("kind").isin("good", bad)).groupBy(_steps(value).alias("step")).agg(F.count_if(F.col("kind") == "good").alias("good"), F.count_if(F.col("kind") == bad).alias("bad")).collect()
    n_good, n_bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not n_good or not n_bad:
        return None
    good, dropped, best = n_good, 0, (-1.0, 0)
    for r in sorted(rows, key=lambda r: r["step"]):
        if good >= LEAST_KEPT * n_good:
            best = max(best, (good / n_good + dropped / n_bad, -r["step"]))
        good, dropped = good - r["good"], dropped + r["bad"]
    return -best[1]


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, n-gram score and verdict of every document."""
    labelled = materialise(labelled_ids(labels), "labelled")
    scored = materialise(score(documents, labelled), "scored")
    judged = scored.where("not base_failed").join(_sent(labelled.where("fold = 1")), "doc_id")
    kept = ~F.col("base_failed")
    for value, bad in ((F.col("score"), "low"), (-F.col("harm"), "toxic")):
        least = threshold(judged, value, bad)
        kept = kept if least is None else kept & (_steps(value) >= least)
    return scored.select(*(c for c in scored.columns if c not in ("score", "harm")), kept.alias("kept"), "score")
