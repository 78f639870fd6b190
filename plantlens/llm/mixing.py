"""Mix sources to target weights.

Every document gets a hash-random key. A source's key range is cut into slices of about `SLICE_ROWS` documents, more
slices for a source with more rows, so the hot source is spread like the rest. Prefix sums of the sizes are exact and
distributed: inside a slice by a window in key order, over slices by a window on one row per slice. A source's budget
is whole epochs plus a cut at the exact place in its key order, the document at the cut giving a part of its words.

Targets fill up like water: all sources get the same level times their weight, up to `MOST_EPOCHS` times their size,
and the level rises until the budget is spent. The level is found from one row per source by rounds, each of which
closes the sources that are full; a round is a two-number aggregate.

Cases: a null source is a source of its own, ordered last; a null text has size 0; documents of size 0 and sources
without words take nothing; repeated rows are separate documents (equal rows get neighbouring places, and it makes
no difference to the result which one comes first); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.words import text_of, unused, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SLICE_ROWS = 4_000
SEED = 17


def cyclic_weight(place: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weight of the source at a place (from 0) of the order of sources."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))


def targets(sources: DataFrame, budget: float, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Add `target` to a table of sources with `source_size` and `weight`."""
    most = F.col("source_size") * F.lit(most_epochs)
    level, closed = 0.0, None
    while True:
        full = most <= F.col("weight") * F.lit(level)
        n, held, weight = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most).otherwise(0.0)),
                                      F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == closed or not weight:
            break
        closed, level = n, max(0.0, budget - held) / weight
    return sources.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS,
        seed: int = SEED, slice_rows: int = SLICE_ROWS, tie: str | None = None) -> DataFrame:
    """Add source_size, target and taken to a table with doc_id, source and size; its other columns stay. `tie` names a column
    that orders rows of one id and size."""
    # names of own columns, whatever the table's are called
    of_source, of_slice, key, unit, slices, slice_, inside, ahead = (
        unused(sized, f"mix_{n}") for n in ("of_source", "of_slice", "key", "unit", "slices", "slice", "inside", "ahead"))
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", cyclic_weight(F.row_number().over(order) - 1, weights))
    total = by_source.agg(F.sum("source_size")).first()[0] or 0
    wanted = targets(ranked, share * total, most_epochs).select(
        F.col("source").alias(of_source), "source_size", "target", F.ceil(F.col("n_docs") / slice_rows).alias(slices))
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    share_of = F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))
    placed = (sized.withColumn(key, hashed).drop("source_size", "target", "taken").join(wanted, F.col("source").eqNullSafe(F.col(of_source)))
              .drop(of_source).withColumn(slice_, F.floor(share_of * F.col(slices))).withColumn(unit, share_of))
    sums = placed.groupBy("source", slice_).agg(F.sum("size").alias("slice_size"))
    before = sums.select(F.col("source").alias(of_source), F.col(slice_).alias(of_slice),
                         (F.sum("slice_size").over(Window.partitionBy("source").orderBy(slice_)) - F.col("slice_size")).alias(ahead))
    within = Window.partitionBy("source", slice_).orderBy(unit, key, "doc_id", "size", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    start = F.col(ahead) + F.col(inside) - F.col("size")
    rest = words - epochs * F.col("source_size") - start
    return (placed.withColumn(inside, F.sum("size").over(within))
            .join(before, F.col("source").eqNullSafe(F.col(of_source)) & (F.col(slice_) == F.col(of_slice)))
            .withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long"))
            .drop(of_source, of_slice, ahead, inside, slice_, slices, key, unit))


def cuts(sized: DataFrame, tie: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS,
         seed: int = SEED) -> DataFrame:
    """One row per source: of_source, epochs, and where its order is cut: the `place` of the document there and the words that
    rows at that place take. Rows of one place (equal id, size and `tie`) share what is left there evenly; the mix is short by
    less than one word for each of them. Whole rows need not be moved to be mixed: `taken` compares their own place."""
    slim = mix(sized.select("source", "doc_id", "size", F.col(tie).alias("tie")), weights, share, most_epochs, seed, tie="tie")
    rows = stored(slim.select("source", "source_size", "target", "size", "taken", _place("doc_id", "size", "tie", seed).alias("place")), "taken")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0)
    rest = rows.select("source", epochs.alias("epochs"), "place", "size", (F.col("taken") - epochs * F.col("size")).alias("rest"))
    # of the places that take some of their words, only the one at the cut does not take all
    places = rest.where("size > 0").groupBy("source", "epochs", "place", "size").agg(F.sum("rest").alias("rest"), F.count("*").alias("copies"))
    ahead = places.where(F.col("rest") == F.col("copies") * F.col("size")).groupBy("source").agg(F.max("place").alias("last_whole"))
    at = places.where((F.col("rest") > 0) & (F.col("rest") < F.col("copies") * F.col("size"))).select(
        F.col("source").alias("cut_source"), F.col("place").alias("cut_place"), F.floor(F.col("rest") / F.col("copies")).alias("cut_words"))
    sources = rest.groupBy(F.col("source").alias("of_source")).agg(F.max("epochs").alias("epochs"))
    return (sources.join(ahead, F.col("of_source").eqNullSafe(F.col("source")), "left").drop("source")
            .join(at, F.col("of_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"))


def _place(doc_id: str, size: str, tie: str, seed: int) -> Column:
    """A row's place in the order of its source."""
    key = F.xxhash64(F.lit(seed), doc_id)
    return F.struct((F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))).alias("unit"), key.alias("key"), F.col(doc_id).alias("id"),
                    F.col(size).alias("n"), F.col(tie).alias("tie"))


def taken(tie: str, seed: int = SEED) -> Column:
    """Words that a row with doc_id, size and `tie` takes, joined with the row of `cuts` of its source."""
    place = _place("doc_id", "size", tie, seed)
    more = F.when(place <= F.col("last_whole"), F.col("size")).when(place == F.col("cut_place"), F.col("cut_words")).otherwise(0)
    return (F.col("epochs") * F.col("size") + more).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words of the text."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, words taken, source."""
    return mix(stored(measured(docs), "sizes")).select("doc_id", "size", "source_size", "target", "taken", "source")
