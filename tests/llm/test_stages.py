"""Stages of the pipeline against brute force with the stages' own bounds."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import LOWER, ODD, WORD, near_copies, table

from plantlens.llm import mixing, ngram_join, pieces, stages
from plantlens.llm.words import text_of, word_count


def five_word_sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def survivors(rows):
    """The least doc_id of each group of texts with a five-word Jaccard similarity of at least 0.8."""
    sets = {r.doc_id: five_word_sets(r.text) for r in rows}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    return sorted({i for i in sets if least[i] == i})


def between_bounds():
    """Pairs whose similarity is at least 0.8 on five words and under 0.85 on four."""
    base, other = [f"b{i}" for i in range(200)], [f"o{i}" for i in range(200)]
    changed = list(other)
    for i in (20, 70, 120, 170):
        changed[i] = f"x{i}"
    return [" ".join(w) for w in (base, base + [f"t{i}" for i in range(40)], other, changed)]


def test_near_copies_of_the_stage(spark):
    docs = table(spark, between_bounds())
    assert sorted(r.doc_id for r in stages.one_of_each_group(docs).collect()) == survivors(docs.collect()) == [0, 2]
    docs = table(spark, between_bounds() + near_copies() + ODD)
    assert sorted(r.doc_id for r in stages.one_of_each_group(docs).collect()) == survivors(docs.collect())


def test_languages_of_a_table_without_labels(spark):
    docs = table(spark, ["clean words", None, "", "12 !", "ελληνικά", "నీరు"], lang=F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in stages.known_language(docs).collect()) == [0, 4, 5]


def shifted(k):
    return " ".join(f"w{i}" for i in range(k, k + 200))


def test_null_and_repeated_ids_link_and_stay(spark):
    """A text without an id links two others; one document of each group stays, whatever its id."""
    rows = [(1, shifted(0)), (None, shifted(12)), (2, shifted(24)), (None, "alone without an id"), (7, "one text"), (7, "quite another text"), (7, "one text"), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "kept": F.lit(0), "component": F.lit(1)})
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.similar_groups(docs.where("length(text) > 100")).collect()}
    assert found == {(1, 197): 1, (None, 197): 1, (2, 197): 1}
    kept = sorted((str(r.doc_id), r.text or "") for r in stages.one_of_each_group(docs).collect())
    assert kept == sorted([("1", rows[0][1]), ("None", rows[3][1]), ("7", rows[4][1]), ("7", rows[5][1]), ("8", ""), ("8", "")])


def test_mix_of_the_stage_is_the_operators(spark, small):
    """Words taken from each source, and from each document but equal ones, are those of the operator."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    words = {k: sum(len(WORD.findall(r.text or "")) for r in rows) for k, rows in _by_source(stages.mixed(docs).collect()).items()}
    sized = docs.select("doc_id", "source", word_count(text_of()).alias("size"))
    want = {r.source: r.words for r in mixing.mix(sized).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    rows = docs.groupBy("source").count().collect()
    assert all(0 <= want[r.source] - words.get(r.source, 0) < r["count"] for r in rows)
    once = docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    got = {}
    for r in stages.mixed(once).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert got == {r.doc_id: r.taken for r in mixing.mix(once.select("doc_id", "source", word_count(text_of()).alias("size"))).collect() if r.taken}


def _by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def test_stages_of_an_empty_table(spark):
    docs = table(spark, ["x"]).where("false")
    for stage in (stages.known_language, stages.one_of_each_group, stages.without_personal_data, stages.mixed):
        assert stage(docs).collect() == []


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"s{i % 2}", 3 + i % 4) for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, source string, size long")
    extra = plain.withColumns({n: F.col("doc_id") * 10 for n in ("key", "unit", "slice", "slices", "inside", "ahead", "mix_key", "taken")})
    found = {r.doc_id: r for r in mixing.mix(extra).collect()}
    assert all(r.key == r.unit == r.slice == r.slices == r.inside == r.ahead == r.mix_key == 10 * i for i, r in found.items())
    assert {i: r.taken for i, r in found.items()} == {r.doc_id: r.taken for r in mixing.mix(plain).collect()}
    assert mixing.digest(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_pieces_of_the_stage_are_the_n_best(spark):
    """The stage returns what the operator finds, the next segmentations by A* included."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, ["a plain sentence of words", "\u2581 odd", "", None, "x"], source=F.lit("s"))
    want = {r.doc_id: r for r in pieces.digest(docs, path).collect()}
    found = stages.tokenized(docs, path).collect()
    assert len(found) == 5 and max(len(r.next_ids) for r in found) == pieces.N_BEST - 1
    for r in found:
        w = want[r.doc_id]
        assert (r.n_pieces, r.score, r.next_scores, r.decodes) == (w.n_pieces, w.score, w.next_scores, w.round_trip)
        assert [zlib.crc32(np.array(x, "<u2").tobytes()) for x in r.next_ids] == w.next_crc32
