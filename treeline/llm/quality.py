"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word uni- and bigrams are hashed into ``BUCKETS`` buckets.  One multinomial is counted
over all documents, two over the trusted documents of either fold (a hash of the id); a document's score is the
mean of its n-grams' log ratios, so it doesn't depend on the length, under the target that was counted on the
other fold.  So no document is judged by a target that it helped to count, labelled or not.  The
threshold is that which ``KEPT_TRUSTED`` of the trusted documents that pass the base rules (length and repetition)
reach under the other fold's target, the same for every document; each is held against it (no sampling of documents).
Both sides are counted, and the threshold taken, over all their documents.

All on DataFrame functions; no Python runs on the executors.  Trusted ids are broadcast as a bitmap, whole, and no text
is shuffled; only ids that are no integers, or so sparse that they fill over ``MAX_WORDS`` words, are joined with the texts.
Null text has no words.  Rows are judged one by one, so repeated rows and ids and null ids (fold 0)
need no care; a very long text's word arrays are held in one row.  Without trusted rows all scores are 0 and
the threshold rejects none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from treeline.llm.shared import staged

BUCKETS = 1 << 14
#: Words of 64 ids that a broadcast bitmap may have (67 million documents of dense ids).
MAX_WORDS = 1 << 20
#: Bins that the range of the scores is cut into at a time.
BINS = 4096
#: Share of the trusted documents, each under the other fold's target, that the threshold keeps.
KEPT_TRUSTED = 0.99
FOLDS = 2
#: Weight of the raw distribution in the target, in n-grams for each bucket.
PRIOR = 4
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def with_words(docs: DataFrame, text_column: str = "text", words: str = "_words") -> DataFrame:
    return docs.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text_column), F.lit("")), SPACES), ""))


def _ngrams(words: Column) -> Column:
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(words, i + 1)))
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def trusted_ids(labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """Ids labelled good and not toxic by all their rows: all of them, or on request about ``max_trusted`` by hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    if max_trusted is None:
        return good
    step = max(1, math.ceil(good.count() / max_trusted))
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)


def marker(labels: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What adds ``trusted``, a boolean, to documents with a ``doc_id``; every trusted id counts."""
    trusted = staged(trusted_ids(labels), "trusted")
    integral = isinstance(trusted.schema["doc_id"].dataType, IntegralType)
    place = F.col("doc_id").cast("long")
    word, bit = F.shiftright(place, 6).alias("_word"), place.bitwiseAND(F.lit(63)).cast("int")
    if integral:
        words = staged(trusted.select(word, bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")), "trusted-words")
        integral = words.count() <= MAX_WORDS

    def marked(docs: DataFrame) -> DataFrame:
        if integral and isinstance(docs.schema["doc_id"].dataType, IntegralType):
            found = docs.withColumn("_word", word).join(F.broadcast(words), "_word", "left")  # at most MAX_WORDS rows
            return found.withColumn("trusted", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))).drop("_word", "_bits")
        return docs.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))

    return marked


def percentile(values: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile of a column, as ``F.percentile`` has it; None without values.

    The bin that holds its rank is cut into bins again until it is a single value, so neither the driver nor a task
    gets more than ``BINS`` rows.
    """
    score = F.col(column)
    found = [F.count(score).alias("n"), F.min(score).alias("low"), F.max(score).alias("high")]
    n, low, high = values.agg(*found).first()
    if not n:
        return None
    at, before = (n - 1) * share, 0
    rank = math.floor(at)
    while low < high:
        place = F.least(F.floor((score - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        bins = values.where(score.between(low, high)).groupBy(place.alias("bin")).agg(*found).orderBy("bin").collect()  # at most BINS rows
        k = 0
        while before + bins[k].n <= rank:
            before, k = before + bins[k].n, k + 1
        if at > rank and before + bins[k].n == rank + 1:  # the next rank is in the next bin
            return (rank + 1 - at) * bins[k].high + (at - rank) * bins[k + 1].low
        low, high = bins[k].low, bins[k].high
    return low


def fold(doc_id: Column) -> Column:
    return F.pmod(F.coalesce(F.xxhash64(F.lit("fold"), doc_id), F.lit(0)), F.lit(FOLDS)).cast("int")


def log_ratios(docs: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> list[list[float]]:
    """For each fold the log ratio of each bucket: target of the other folds, smoothed towards raw, against raw."""
    own = F.when(F.col("trusted"), fold(F.col("doc_id")))
    words = with_words(marked(docs.select("doc_id", "text")).withColumn("trusted", own))
    grams = words.select("trusted", F.explode(_ngrams(F.col("_words"))).alias("bucket"))
    targets = [F.count_if(F.col("trusted") != k).alias(f"t{k}") for k in range(FOLDS)]
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), *targets).collect()  # at most BUCKETS rows
    raw = [0] * BUCKETS
    target = [[0] * BUCKETS for _ in range(FOLDS)]
    for r in rows:
        raw[r.bucket] = r.raw
        for k in range(FOLDS):
            target[k][r.bucket] = r[f"t{k}"]
    n_raw, out = sum(raw), []
    for own in target:
        n_target, ratios = sum(own), []
        for x, t in zip(raw, own, strict=True):
            p = (x + 1) / (n_raw + BUCKETS)
            ratios.append(math.log((t + PRIOR * BUCKETS * p) / (n_target + PRIOR * BUCKETS) / p))
        out.append(ratios)
    return out


def _repeated_words(words: Column, hashes: str) -> tuple[Column, Column]:
    """(the windows of a text as sorted (hash, place) if any is repeated, words that repeated ones cover)."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))
    ordered = F.col(hashes)
    same = lambda x, i: F.coalesce((F.get(ordered, i)["h"] == x["h"]), F.lit(False))
    repeated = F.filter(ordered, lambda x, i: same(x, i + 1) | (F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))
    return F.array_sort(windows), covered


def measured(docs: DataFrame, ratios: list[list[float]]) -> DataFrame:
    """All columns of ``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score``."""
    tables = [F.expr(f"cast(split('{','.join(f'{x:.7f}' for x in own)}', ',') as array<double>)") for own in ratios]
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    ordered, covered = _repeated_words(words, "_ordered")
    total = lambda table: F.aggregate("_grams", F.lit(0.0), lambda sum_, b: sum_ + F.get(table, b))
    summed = total(tables[0])
    for k in range(1, FOLDS):
        summed = F.when(fold(F.col("doc_id")) == k, total(tables[k])).otherwise(summed)
    found = (
        with_words(docs)
        .withColumns({"_ordered": ordered, "_lines": lines, "_grams": _ngrams(words)})
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "score": F.coalesce(F.try_divide(summed, F.size("_grams")), F.lit(0.0)),
        })
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).drop("_words", "_ordered", "_lines", "_grams")


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """(log ratios by fold, threshold), from all documents and the trusted ids."""
    marked = marker(labels)
    ratios = log_ratios(docs, marked)
    own = marked(docs.select("doc_id", "text")).where("trusted")
    scores = staged(measured(own, ratios).select("base_failed", "score"), "trusted-scores").where("not base_failed")  # written first: see kept_by_quality
    least = percentile(scores, "score", 1 - KEPT_TRUSTED)
    return ratios, -math.inf if least is None else least


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``."""
    ratios, threshold = fitted(docs, labels)
    return measured(docs, ratios).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def kept_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its own columns, that the rules keep.

    The verdicts are written to the shared folder first: a filter on them would be pushed below the
    projections, which then compute the word arrays anew for each use.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))  # columns may have the judge's names
    judged = staged(judge_quality(whole, labels).select("_row", "kept"), "judged")
    return judged.where("kept").select("_row.*")
