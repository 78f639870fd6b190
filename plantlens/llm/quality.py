"""Quality rules and a likelihood ratio between trusted text and the whole corpus.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. One pass counts the buckets over
all documents and over the trusted ones, pre-aggregated in each task; the table of weights, log p(trusted) -
log p(corpus) with the corpus as the prior, has one row per bucket and so a fixed size to broadcast. A second pass
looks up every word and pair, sums the weights of a document inside its task, and divides by their number. Weights
are whole millionths and sums are exact, so no score depends on the order of additions. A document passes if its
score is at most `DEVIATIONS` standard deviations under the mean of the trusted documents. Built from SQL functions.

Base rules come from arrays within the row: three-word windows are hashed (64 bits), sorted with their positions,
and equal neighbours mark repeated windows.

Cases: a null text has no words; it fails the base rules and scores 0. Without trusted documents all weights are 0
and the likelihood rule passes everything. Trusted ids that are null, repeated or unknown change nothing. Repeated
rows are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.sized import small_or_shuffled
from plantlens.llm.words import let, text_of, word_array

BUCKETS = 1 << 16
PRIOR_PER_BUCKET = 1.0
DEVIATIONS = 6.0
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Up to so many repeated windows are looked up one by one.
SHORT_LIST = 32
SYMBOLS = "#*$%&|<>"
MICRO = 1_000_000


def _covered(places: Column) -> Column:
    """Number of words in the three-word windows that start at these ascending places."""
    return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                       lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
                       lambda a: a["n"])


def _repeated_places(hashes: Column, repeated: Column) -> Column:
    """Places of the windows whose hash is in a list: by look-up in a short list, by one sort for a long one."""
    short = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull())
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, k: x["h"].eqNullSafe(F.get(s, k)["h"])
    long = let(ordered, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: same(s, x, k + 1) | same(s, x, k - 1)), lambda x: x["i"])))
    return F.when(F.size(repeated) <= SHORT_LIST, short).otherwise(long)


def _repeated_words(words: Column, n: Column) -> Column:
    """Words covered by three-word windows that stand at two or more places of a text."""
    m = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, m), F.slice(words, 2, m), F.slice(words, 3, m))
    twice = lambda s: F.array_distinct(F.filter(s, lambda h, k: h == F.get(s, k - 1)))
    return let(F.transform(windows, lambda w: F.xxhash64(w)), lambda hashes: let(
        let(F.sort_array(hashes), twice),
        lambda repeated: F.when(F.size(repeated) == 0, 0).otherwise(_covered(_repeated_places(hashes, repeated)))))


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the words and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text_of(F.col(f"`{text_col}`"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (df.withColumn("words", word_array(text))
            .withColumn("n_words", F.size("words").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
            .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", _repeated_words(F.col("words"), F.size("words")).cast("long"))
            .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                        | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))))


def _features(df: DataFrame) -> DataFrame:
    """A row for each word and each pair of neighbours, as a bucket; documents without words keep one row without a bucket."""
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    each = df.withColumn("pair", F.explode_outer(pairs)).drop("words")
    both = F.when(F.col("pair.b").isNotNull(), F.array(bucket("pair.a"), bucket("pair.a", "pair.b"))).when(
        F.col("pair.a").isNotNull(), F.array(bucket("pair.a")))
    return each.withColumn("bucket", F.explode_outer(both)).drop("pair")


def mark_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Add `trusted`, true for documents whose doc_id is in the other table."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where(F.col("doc_id").isNotNull()).distinct()
    return (docs.join(small_or_shuffled(ids), F.col("doc_id") == F.col("trusted_id"), "left")
            .withColumn("trusted", F.col("trusted_id").isNotNull()).drop("trusted_id"))


def fit_weights(docs: DataFrame) -> DataFrame:
    """bucket, weight in millionths, from `text` and `trusted` of all documents."""
    rows = _features(docs.select("trusted", word_array(text_of()).alias("words"))).where("bucket IS NOT NULL")
    counts = stored(rows.groupBy("bucket").agg(F.count("*").alias("r"), F.count(F.when(F.col("trusted"), 1)).alias("t")), "buckets")
    total = counts.agg(F.sum("r"), F.sum("t")).first()
    raw, sure = float(total[0] or 1), float(total[1] or 0)
    prior = PRIOR_PER_BUCKET * BUCKETS
    share = F.col("r") / F.lit(raw)
    ratio = F.log((F.col("t") + share * prior) / F.lit(sure + prior)) - F.log(share)
    return counts.select("bucket", F.round(ratio * MICRO).cast("long").alias("weight"))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per document with doc_id, trusted, the base measures and score, the mean weight in millionths."""
    measures = ["doc_id", "trusted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = base_measures(docs.select("doc_id", "text", "trusted")).select(
        F.monotonically_increasing_id().alias("row"), *measures, "words")
    return (_features(base).join(F.broadcast(weights), "bucket", "left").groupBy("row", *measures)
            .agg(F.sum("weight").alias("total"), F.count("bucket").alias("n_features"))
            .select(*measures, F.coalesce(F.floor(F.col("total") / F.col("n_features")), F.lit(0)).cast("long").alias("score")))


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """All documents with base measures, score and kept. `docs` has doc_id and text, `trusted` has doc_id."""
    marked = mark_trusted(docs.select("doc_id", "text"), trusted)
    scored = stored(score(marked, fit_weights(marked)), "quality")
    sums = scored.where("trusted AND NOT base_failed").agg(
        F.count("*"), F.sum("score"), F.sum(F.col("score").cast("decimal(20,0)") * F.col("score"))).first()
    n, mean = sums[0], (sums[1] or 0) / max(sums[0], 1)
    spread = (max(float(sums[2] or 0) / max(n, 1) - mean * mean, 0.0)) ** 0.5
    least = round(mean - DEVIATIONS * spread) if n else None
    passed = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    return scored.withColumn("threshold", F.lit(least).cast("long")).withColumn("kept", ~F.col("base_failed") & passed)
