"""Operators as stages of a pipeline: tables of documents in, tables of documents out.

A row is packed while an operator works on it, so columns of any name come through. Every stage takes nulls, empty
texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm import language, mixing, ngram_join, personal, pieces
from plantlens.llm.sized import small_or_shuffled
from plantlens.llm.words import text_of, unused, word_array, word_count

# Near copies share this much of their five-word shingles; op4's query has bounds of its own.
NEAR_SIZE = 5
NEAR_PERCENT = 80
# Below it only texts whose letters belong to no learned language's script are found.
LEAST_LANGUAGE_SCORE = 0.2


def known_language(docs: DataFrame) -> DataFrame:
    """Documents in a learned language: those without a letter, or in a script that none uses, go. Where no language is
    learned, only those without a letter go."""
    model = language.train(docs.where(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return language.label(packed, model).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the least doc_id, null ones last, and the first row of equal ones. Texts
    without words are in no group and all stay."""
    found = stored(ngram_join.similar_rows(docs, size=NEAR_SIZE, percent=NEAR_PERCENT), "groups")
    first = found.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("kept")).union(found.where("component IS NULL").select("row"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(small_or_shuffled(stored(kept, "kept")), F.col("row_id") == F.col("kept")).select("row.*")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows."""
    spans = unused(docs, "pii_spans")
    found = personal.redact(personal.find_spans(docs, out=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        length = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut keeps its first words, joined by spaces."""
    plain = ["doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64("text").alias("tie")]
    cuts = stored(mixing.cuts(stored(docs.select(*plain), "sizes"), "tie"), "cuts")
    packed = docs.select(*plain, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = (packed.join(small_or_shuffled(cuts), F.col("source").eqNullSafe(F.col("of_source")))
             .select("row", "size", mixing.taken("tie").alias("taken")).where("taken > 0"))
    whole = taken.select("row", F.explode(F.array_repeat(F.lit(1), F.floor(F.col("taken") / F.col("size")).cast("int"))).alias("one")).select("row.*")
    part = taken.where("taken % size > 0").select("row", (F.col("taken") % F.col("size")).cast("int").alias("n")).select(
        *[F.array_join(F.slice(word_array(text_of("row.text")), 1, F.col("n")), " ").alias(c) if c == "text" else
          F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.union(part.select(*[F.col(f"`{c}`") for c in docs.columns]))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, piece_ids, n_pieces, whether the ids decode to the text, the score of this best segmentation, and scores
    and ids of the next ones."""
    encoded = pieces.encode_checked(docs.select("doc_id", "source", "text"), path)
    return encoded.select("doc_id", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "decodes",
                          "score", "next_scores", "next_ids")
