"""Token records, pieces, vectors and the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantlens.functions.lineage import scratch_path
from plantlens.llm import near_vectors, pieces, token_records
from plantlens.llm.components import components
from plantlens.llm.pieces import MARK, Vocabulary

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "  a  b\n\nc ", "x\t y\r\nz", " lead", "trail ", "a b c", "\n", "d  e   f", "don't we'll <|endoftext|> x", "\x1c a\x1cb", "é　 ü", "a \n b",
       "a b c", f"{MARK}mark {MARK}", "日本語 text", "w" * 20_000]


def test_records_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"file": F.lit("x"), "content": F.lit(1)})
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        rows, at, want = sorted((r.doc_id, r.text or "") for r in docs.collect()), 0, []
        for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False)):
            ids = np.array([*e.ids, 2], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, token_records.digest(docs, BPE).collect())) == want
    assert token_records.digest(odd.where("false"), BPE).collect() == []


def test_records_by_index(spark):
    docs = spark.createDataFrame([(7, "seven"), (None, "none"), (3, "three words here"), (7, "again")], "doc_id long, text string")
    folder = scratch_path(spark, "records")
    manifest = token_records.write_records(docs, BPE, folder, file_bytes=40)
    assert manifest.agg(F.sum("records")).first()[0] == 4
    entries = token_records.index(spark, folder).orderBy(F.xxhash64("offset", "file"))
    found = token_records.fetch(spark, folder, entries).collect()
    assert sorted(str(r.doc_id) for r in found) == ["3", "7", "7", "None"] and all(r.ids[-1] == 2 for r in found)


def test_damaged_record():
    data = bytearray(token_records.frame(5, b"\1\0\2\0", False))
    assert [(i, x.tolist()) for i, x in token_records.unframe(memoryview(bytes(data)))] == [(5, [1, 2])]
    data[22] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_records.unframe(memoryview(bytes(data))))


def all_segmentations(v, text):
    chars = ["\0" if c == MARK else MARK if c == " " else c for c in " " + text]
    out = []

    def go(i, score, ids):
        if i == len(chars):
            out.append((score / pieces.MICRO, tuple(ids)))
            return
        single = False
        for k in range(1, min(v.longest, len(chars) - i) + 1):
            p = "".join(chars[i:i + k])
            if "\0" not in p and p in v.piece:
                single |= k == 1
                go(i + k, score + v.piece[p][1], ids + [v.piece[p][0]])
        if not single:
            raw = (" " + text)[i].encode()
            go(i + 1, score + len(raw) * v.byte_score, ids + [v.byte[b] for b in raw])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["a", "the of", "héé ü", "a  b", "\n", "x\ny", " ", " a ", MARK + "a", "hello w", "日本 x", "ab\tc"])
def test_n_best(text):
    v = pieces.vocabulary(PIECES)
    (ids, score, scores, others), = v.encode([text], 4)
    want = all_segmentations(v, text)
    assert [score, *scores] == pytest.approx([s for s, _ in want[:4]])
    found = [tuple(np.frombuffer(x, "<u2").tolist()) for x in (ids, *others)]
    assert len(set(found)) == min(4, len(want)) and all(v.decode(np.array(x)) == text for x in found)
    for s, x in zip([score, *scores], found):
        assert dict((p, t) for t, p in want)[x] == pytest.approx(s)


def test_memory_of_units_does_not_show(monkeypatch):
    texts = [t or "" for t in ODD]
    want = pieces.vocabulary(PIECES).encode(texts)
    monkeypatch.setattr(pieces, "MOST_UNITS", 0)
    assert [x for t in texts for x in Vocabulary(PIECES).encode([t])] == want


def test_units_met_most_are_solved_once(monkeypatch):
    solved = []
    solve = Vocabulary._solve
    monkeypatch.setattr(pieces, "MOST_UNITS", 40)
    monkeypatch.setattr(pieces, "MOST_CHARACTERS", 30)
    monkeypatch.setattr(Vocabulary, "_solve", lambda self, units: (solved.append(list(units)), solve(self, units)))
    v, plain = Vocabulary(PIECES), pieces.vocabulary(PIECES)
    texts = [f"the house of the unit{k} word{k}x" for k in range(100)]
    found = [v.encode([t, "z" * 90])[0] for t in texts]
    units = [u for x in solved for u in x]
    assert units.count(" the") == units.count(" of") == 1 and len(v.units) <= 60
    # units solved together have a bounded number of characters, but for the last one
    assert all(sum(map(len, x[:-1])) < 30 for x in solved)
    monkeypatch.undo()
    assert found == plain.encode(texts)


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("piece_ids", F.lit("clash"))
    rows = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert all(r.round_trip for r in pieces.digest(docs, PIECES).collect())
    assert pieces.digest(docs.where("false"), PIECES).collect() == []


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 48))
    rows = []
    for c in range(40):
        rows += [(centres[c] + 0.2 * rng.normal(size=48)).tolist() for _ in range(12)]
    rows += [rows[0], rows[0], (np.array(rows[1]) * 3).tolist()]
    data = [(i, v, i % 2) for i, v in enumerate(rows)]
    odd = [(900, None, 1), (901, [0.0] * 48, 1), (902, [float("nan")] * 48, 1), (903, [None] * 48, 1), (904, rows[0], None), (905, rows[0][:20], 0),
           (906, [], 1), (None, rows[0], 0)]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1))
    got = {r.vec_id: r for r in near_vectors.near_vectors(vectors).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.add.outer(np.arange(len(x)), np.arange(len(x))) % 2 == 0)
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum() > 0
    assert got[0].n_links >= 1 and got[480].component_id == 0 and not got[480].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    assert near_vectors.near_vectors(vectors.where("false")).collect() == []


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(near_vectors.hadamard(near_vectors.hadamard(x)), x) and np.allclose((near_vectors.hadamard(x) ** 2).sum(1), (x ** 2).sum(1))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 90 for i in (90, 95, 100)}, **{200 + i: 200 for i in range(30)}}


def test_pipeline(spark, small):
    import corpus_pipeline
    from test_text_operators import WORD, base_spans, groups_of

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6 + i, t, None, None, 0) for i, t in enumerate(ODD[:-1])], docs.schema)
    at = docs.union(odd).withColumns({"score": F.lit(1), "row": F.lit("r"), "kept_id": F.lit(None).cast("int")})
    for name, stage in corpus_pipeline.STAGES:
        before = at.collect()
        path = scratch_path(spark, "stage")
        out = stage(spark, at, small)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        rows = after.collect()
        if name != "pieces":
            assert after.columns == at.columns
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in rows}
            assert all(i >= 10 ** 6 for i in gone) and {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 7} <= gone
        if name == "ngram_join":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c in groups_of(before).values()})
        if name == "pii":
            was = {r.doc_id: r for r in before}
            assert all(r.text == was[r.doc_id].text if not base_spans(was[r.doc_id].text) else r.text != was[r.doc_id].text for r in rows)
        if name == "mixing":
            count = lambda x: sum(len(WORD.findall(r.text or "")) for r in x)
            assert abs(count(rows) - 1.5 * count(before)) <= len({r.source for r in before})
        if name == "pieces":
            assert len(rows) == len(before) and all(r.decodes and r.n_pieces == len(r.piece_ids) for r in rows)
        at = after


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing(spark, small, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, small).count() == 0
