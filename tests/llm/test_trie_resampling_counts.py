"""The prefix trie, importance resampling and token counts against brute force, on odd tables and small bounds."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantlens.llm import prefix_trie, resampling, token_counts, trie_forest
from plantlens.llm.crc_spans import crc32_spans
from plantlens.llm.parts import parts
from plantlens.llm.places import places
from plantlens.llm.pretokens import dictionary, pre_tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\n", "a", "don't  stop\n's 've 'S", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|", "naïve é ü ß \u0085x", "z" * 5000,
       "-" * 3000 + " " + "é" * 2000, " ".join(f"word{i % 7}" for i in range(300)), "x\r\n\t y", "同じ 文 १२३ \U0001f600!", "A a B b " * 30, "tail ", "word " * 25]


# ---- places

def test_places_over_partitions(spark):
    rows = [(g, k % 5) for g, n in ((-3, 1), (0, 700), (1, 2), (7, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, v long").withColumns({"place_group": F.lit("x"), "place_part": F.lit(1)}).repartition(5)
    found = places(df, [F.col("v").desc()], "g").collect()
    for g, n in ((-3, 1), (0, 700), (1, 2), (7, 40)):
        mine = sorted((r.place, r.v) for r in found if r.g == g)
        assert [p for p, _ in mine] == list(range(1, n + 1)) and [v for _, v in mine] == sorted((k % 5 for k in range(n)), reverse=True)
    everything = places(df, [F.col("g")], name="rank").collect()
    assert sorted(r["rank"] for r in everything) == list(range(1, 744))
    assert places(df.where("false"), [F.col("v")], "g").count() == 0


# ---- prefix trie

def brute_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(ts, key=lambda v: v[:2])] for c, ts in turns.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - math.trunc(math.fmod(c, 100)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    below = {}
    for k in sorted(nodes, key=len, reverse=True):
        kids = children.get(k, [])
        own = (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        below[k] = (sum(below[x][0] for x in kids) if kids else 1, own + sum(below[x][1] for x in kids))
    ends = {k: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), *below[k],
                   hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


def found_trie(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_trie(df).select(*prefix_trie.NODE).collect())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns(
        {"p": F.lit("x"), "depth": F.lit(0), "seg": F.lit(None).cast("int"), "place": F.lit(9), "h": F.lit("h")})


def some_rows(rng, n, longest):
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.15:
            continue
        length = rng.randrange(1, longest)
        said = [(None if k == 0 and rng.random() < 0.2 else k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ü\U0001f600", "", None]))
                for k in range(length)]
        if rng.random() < 0.4:
            said = [(k, "user", "hello") for k in range(length)]
        rows += [(c, *s) for s in said]
    rng.shuffle(rows)
    return rows + [(None, 0, "user", "nobody's")]


@pytest.mark.parametrize("per_batch", ["3", "10000"])
def test_trie(spark, per_batch):
    rows = some_rows(random.Random(4), 260, 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        assert found_trie(conversations(spark, rows)) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("per_batch", ["2", "10000"])
def test_trie_of_long_conversations(spark, per_batch):
    """Conversations of several segments that share one or more of them."""
    n = trie_forest.SEGMENT
    rows = []
    for c, length, apart in ((100, 3 * n + 5, 10**6), (205, n, 10**6), (206, n + 1, 10**6), (207, 2 * n, 10**6), (208, 2 * n, 10**6), (209, 3 * n + 5, 2 * n + 1),
                             (210, 3 * n + 5, n), (211, 3 * n + 5, 2 * n + 1), (212, 3, 10**6), (213, 3 * n + 5, 10**6), (100 + 300, 2 * n + 7, 10**6)):
        rows += [(c, k, "user", "same" if k < apart else f"other{k % 3}") for k in range(length)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        assert found_trie(conversations(spark, rows)) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_copies_ties_and_nothing(spark):
    rows = [(c, k, "user", "one") for c in range(500, 3500) for k in range(2)] + [(9, 1, "a", "x"), (9, 1, "a", "x"), (9, 1, "b", "y")]
    found = found_trie(conversations(spark, rows))
    assert [r for r in found if r[0] != 9 or r[1] < 1] == [r for r in brute_trie(rows) if r[0] != 9 or r[1] < 1]
    assert found_trie(conversations(spark, rows).where("false")) == []
    assert found_trie(conversations(spark, [(None, 1, "a", "b")])) == []


# ---- checksums and resampling

def test_checksums_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 100_000, dtype=np.uint8)
    raw = data.tobytes()
    for longest in (1, 9, 64, 65, 129, 4000, 90_000):
        starts = rng.integers(0, len(raw) - longest, 200)
        ends = starts + rng.integers(1, longest + 1, 200)
        assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    assert len(crc32_spans(data, starts[:0], ends[:0])) == 0


def features(text, most):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute_resample(docs, target, most, percent=10, least=20):
    from collections import Counter

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x, most)[1]))
    for x in target:
        t.update(map(bucket, features(x, most)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        words, found = features(x, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[:percent * len(enough) // 100])}
    return sorted(((r[0], *r[2:], drawn.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, most):
    rng = random.Random(most)
    pool = ["The", "cat", "naïve", "2024", "ß", "w" * 70, "dog", "x" * 200, "aim", "É"]
    texts = ODD + [rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    docs = [(k if k != 40 else None, x) for k, x in enumerate(texts)] + [(41, texts[41])]
    target = ["the cat and the dog", None, "naïve 2024", "x" * 200]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "rank": F.lit(0), "bucket": F.lit(1)})
    other = spark.createDataFrame([(x,) for x in target], "text string")
    found = resampling.resample(df, other, most_words=most)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_resample(docs, target, most)


def test_resampling_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(df.where("false"), df.where("false")).count() == 0
    assert [r["rank"] for r in resampling.resample(df, df.where("false")).collect()] == [None]


# ---- token counts

def test_pretokens_like_the_library():
    cutter = pre_tokenizer(TOKENIZER)
    rng = random.Random(8)
    alphabet = list("ab1 '\n\t\u0085é中٣!stredmlvᠠ\U0001f600\x1c ") + ["'s", "'ve", "'ll", " '", "<|endoftext|>", "<|end", "  ", "\r\n"]
    texts = [x or "" for x in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for size in (64, 1 << 20):
        found = []
        for first, last, edges, data in parts(pa.array(texts), size):
            starts, before = cutter.cut(data, edges)
            values, index = dictionary(data, starts)
            each = [values[i].as_py() for i in index.tolist()]
            found += [each[before[k]:before[k + 1]] for k in range(last - first)]
        for x, pieces in zip(texts, found, strict=True):
            want = []
            for k, part in enumerate(x.split("<|endoftext|>")):
                want += ["<|endoftext|>"] * (k > 0) + [part[a:b] for _, (a, b) in cutter.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            assert pieces == want


@pytest.mark.parametrize(("head", "long"), [(token_counts.HEAD_BYTES, token_counts.LONG_BYTES), (200, 8), (0, 1 << 20), (0, 0)])
def test_token_counts(spark, small, head, long):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rows = [(k if k != 5 else None, x) for k, x in enumerate(ODD)] + [(6, ODD[6]), (7, ODD[11])]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "piece": F.lit(0), "n": F.lit(1)})
    found = token_counts.token_counts(df, TOKENIZER, head, long).collect()
    want = [(i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False))) for i, x in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_token_counts_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert token_counts.digest(df.where("false"), TOKENIZER).count() == 0
    assert [tuple(r) for r in token_counts.digest(df, TOKENIZER).collect()] == [(1, 3, 2, False)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pre_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
