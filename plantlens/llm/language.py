"""Languages of texts and of spans inside mixed texts.

Training counts byte trigrams of lower-cased words for each language over all training documents, in one pass whose
per-task tables are added up by Spark; the model has a fixed number of rows for each language. Script ranges narrow the
candidates of a word to the languages that use its script; the word's score for a candidate is the sum of its trigrams'
log-probabilities, measured from the best one and cut off, so that no single word decides. Viterbi over the words with
a penalty for a change of language labels spans; all documents of a batch take a step together. A document's language
is the one with most of its letters' words, its score their share.

Cases: a text that is null or has no letter is `und` with score 0; letters of scripts that no
language uses give the first language with score 0; with no training document everything is `und`;
ties go to the language that comes first in code-point order; repeated rows are labelled one by one; a null doc_id is
never trained on; extra columns are kept by `label`, except those whose names it sets.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.sized import in_batches
from plantlens.llm.wordhash import Words, words

TRIGRAMS = 1 << 15
SWITCH_PENALTY = 8.0
WORD_CUT = 6.0
SMOOTHING = 0.5
# A language uses a script if so much of its training letters is in it.
LEAST_SCRIPT_SHARE = 0.01
MOST_LANGUAGES = 1000
UNKNOWN = "und"

# First and last code points of scripts. All other scripts follow from the names of their letters.
SCRIPTS = [
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC0, 0x24F), ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF),
    ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
]
LISTED = list(dict.fromkeys(s for s, _, _ in SCRIPTS))
# Letters and marks outside these ranges have the script that their character names begin with.
LAST_NAMED = 0x34000
NAME_OF = {"GREEK": "Greek", "CYRILLIC": "Cyrillic", "LATIN": "Latin", "FULLWIDTH": "Latin", "ARMENIAN": "Armenian", "HEBREW": "Hebrew",
           "ARABIC": "Arabic", "DEVANAGARI": "Devanagari", "BENGALI": "Bengali", "TAMIL": "Tamil", "THAI": "Thai", "GEORGIAN": "Georgian",
           "HANGUL": "Hangul", "HIRAGANA": "Kana", "KATAKANA": "Kana", "KATAKANA-HIRAGANA": "Kana", "HENTAIGANA": "Kana", "CJK": "Han"}
# Names of signs that no script has for itself, and first words that are not enough.
NO_SCRIPT = frozenset("""ALEF ANGSTROM BET BLACK-LETTER CARON COMBINING DALET DOUBLE-STRUCK EULER FEMININE GIMEL HALFWIDTH IDEOGRAPHIC
    INFORMATION KELVIN MASCULINE MATHEMATICAL MICRO MODIFIER MUSICAL OHM PLANCK ROMAN SCRIPT SUPERSCRIPT TURNED VARIATION VEDIC
    VERTICAL""".split())
TWO_WORDS = frozenset(["INSCRIPTIONAL", "LINEAR", "NEW", "OLD", "TAI"])


def _named_script(code: int) -> str:
    """The script in the name of a letter or mark; empty for other characters and for signs of all scripts."""
    c = chr(code)
    if unicodedata.category(c)[0] not in "LM":
        return ""
    name = unicodedata.name(c, "").split()
    if name[:1] == ["HALFWIDTH"]:
        name = name[1:]
    if not name or name[0] in NO_SCRIPT:
        return ""
    return NAME_OF.get(name[0], " ".join(name[:2 if name[0] in TWO_WORDS else 1]))


def _script_table() -> tuple[list[str], np.ndarray]:
    """Names of scripts, and script number (from 1; 0 is none) by code point."""
    names, table = {s: i + 1 for i, s in enumerate(LISTED)}, np.zeros(1 << 21, np.uint8)
    for code in range(0x80, LAST_NAMED):
        if name := _named_script(code):
            table[code] = names.setdefault(name, len(names) + 1)
    for name, first, last in SCRIPTS:
        table[first:last + 1] = names[name]
    return list(names), table


SCRIPT_NAMES, _SCRIPT = _script_table()
_ASCII_SCRIPT = np.where(np.arange(256) < 128, _SCRIPT[:256], 0).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """True for the documents kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _trigrams(part: Words) -> np.ndarray:
    """For each byte the number of the trigram around it; a word's neighbours stand for its edges."""
    low = _LOWER[part.data]
    low[low < 33] = 32
    code = np.full(len(low), 0, np.uint32)
    left, right = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[part.starts], right[part.ends - 1] = 32, 32
    code = (left << 16 | low << 8 | right) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


def _scripts(part: Words) -> np.ndarray:
    """For each byte the script of the character that starts there."""
    found = _ASCII_SCRIPT[part.data]
    at = np.flatnonzero(part.data >= 0xC0)
    if len(at):
        data = np.append(part.data, np.zeros(3, np.uint8)).astype(np.uint32)
        lead, b, c, d = data[at], data[at + 1] & 63, data[at + 2] & 63, data[at + 3] & 63
        code = np.where(lead < 0xE0, (lead & 31) << 6 | b, np.where(
            lead < 0xF0, (lead & 15) << 12 | b << 6 | c, (lead & 7) << 18 | b << 12 | c << 6 | d))
        found[at] = _SCRIPT[code]
    return found


def _spread(part: Words) -> np.ndarray:
    """For each byte of a word the number of its word; -1 between words."""
    change = np.zeros(len(part.data) + 1, np.int64)
    change[part.starts] = 1
    inside = np.zeros(len(part.data) + 1, np.int64)
    inside[part.starts] += 1
    np.subtract.at(inside, part.ends, 1)
    return np.where(np.cumsum(inside[:-1]) > 0, np.cumsum(change[:-1]) - 1, -1)


@dataclass
class Model:
    """Languages in code-point order, log-probabilities by trigram and language, and which language uses which script."""

    languages: list[str]
    trigrams: np.ndarray
    uses: np.ndarray


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}
    wide = TRIGRAMS + len(SCRIPT_NAMES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), wide), np.int64)
        for batch in batches:
            of_row = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for part in words(batch.column("text")):
                if not len(part.starts):
                    continue
                word = _spread(part)
                inside = word >= 0
                row = np.searchsorted(part.bounds, np.arange(len(part.starts)), side="right") - 1 + part.first
                lang = of_row[row[word[inside]]]
                total += np.bincount(lang * wide + _trigrams(part)[inside], minlength=total.size).reshape(total.shape)
                total += np.bincount(lang * wide + TRIGRAMS + _scripts(part)[inside], minlength=total.size).reshape(total.shape)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])],
                                         names=["lang", "slot", "n"])
    return run


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of all rows whose lang is not null."""
    docs = docs.select("text", "lang").where("lang IS NOT NULL")
    found = [r.lang for r in docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(found)
    wide = TRIGRAMS + len(SCRIPT_NAMES) + 1
    counts = np.zeros((max(len(languages), 1), wide))
    if languages:
        added = in_batches(docs, _count(languages), "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        for r in added.toLocalIterator():
            counts[r.lang, r.slot] = r.n
    tri, script = counts[:, :TRIGRAMS] + SMOOTHING, counts[:, TRIGRAMS:].copy()
    script[:, 0] = 0
    share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.log(tri / tri.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), (share >= LEAST_SCRIPT_SHARE).T.copy())


def _word_scores(part: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages, the best 0) and whether a word's script is one that a language uses."""
    n, width = len(part.starts), len(model.languages)
    script = np.maximum.reduceat(_scripts(part), part.starts) if n else np.zeros(0, np.uint8)
    tri = _trigrams(part)
    score = np.empty((n, width), np.float32)
    sums = np.zeros(len(part.data) + 1)
    for k in range(width):
        np.cumsum(model.trigrams[tri, k], dtype=np.float64, out=sums[1:])
        score[:, k] = sums[part.ends] - sums[part.starts]
    allowed = model.uses[script]
    score[~allowed & allowed.any(axis=1, keepdims=True)] -= 4 * WORD_CUT
    score -= score.max(axis=1, keepdims=True)
    np.maximum(score, -WORD_CUT, out=score)
    # a word of letters in a script that no language uses, or without letters, speaks for none
    voiced = (script > 0) & allowed.any(axis=1)
    score[~voiced] = 0
    return score, voiced


def viterbi(score: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best state of each step of many sequences; sequence k has the steps bounds[k]..bounds[k+1]-1."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    start, length = bounds[:-1][order], length[order]
    state = np.zeros(len(score), np.int64)
    if not len(score):
        return state
    came, stay = np.zeros(len(score), np.int64), np.ones(score.shape, bool)
    value = np.zeros((len(order), score.shape[1]))
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    for t, m in enumerate(active):
        at = start[:m] + t
        v = value[:m]
        best = v.argmax(axis=1)
        moved = v[np.arange(m), best] - penalty
        stay[at] = v >= moved[:, None]
        came[at] = best
        value[:m] = np.maximum(v, moved[:, None]) + score[at]
    last = length > 0
    now = value.argmax(axis=1)
    state[(start + length - 1)[last]] = now[last]
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        at = start[:m] + t
        s = state[at]
        state[at - 1] = np.where(stay[at, s], s, came[at])
    return state


def _lettered_rows(column: pa.Array, part: Words) -> np.ndarray:
    """Whether each row has a letter: by its bytes where they are ASCII, by its characters else."""
    ascii_letter = ((part.data | 32) >= 97) & ((part.data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    lo, hi = part.bounds[:-1], part.bounds[1:]
    has = np.zeros(len(lo), bool)
    filled = hi > lo
    has[filled] = sums[part.ends[hi[filled] - 1]] > sums[part.starts[lo[filled]]]
    for k in np.flatnonzero(filled & ~has):
        has[k] = any(c.isalpha() for c in column[part.first + int(k)].as_py())
    return has


def _label(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        width = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            column = batch.column("text")
            for part in words(column):
                n = part.last - part.first
                rows = batch.slice(part.first, n)
                has = _lettered_rows(column, part) if width else np.zeros(n, bool)
                if width and len(part.starts):
                    score, voiced = _word_scores(part, model)
                    state = viterbi(score, part.bounds)
                    row = np.searchsorted(part.bounds, np.arange(len(state)), side="right") - 1
                    votes = np.bincount(row[voiced] * width + state[voiced], minlength=n * width).reshape(n, width)
                else:
                    state, row, votes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((n, max(width, 1)), np.int64)
                best = np.where(has, votes.argmax(axis=1), width)
                share = np.where(has, votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1), 0.0)
                new = np.ones(len(state), bool)
                new[1:] = (state[1:] != state[:-1]) | (row[1:] != row[:-1])
                new &= has[row]
                at = np.flatnonzero(new)
                following = np.append(at[1:], len(state))
                ends = np.minimum(following, part.bounds[1:][row[at]]) - part.bounds[:-1][row[at]]
                spans = pa.StructArray.from_arrays([
                    pa.array((at - part.bounds[:-1][row[at]]).astype(np.int32)), pa.array(ends.astype(np.int32)),
                    pa.array(names[state[at]].tolist(), pa.string())], names=["start", "end", "lang"])
                offsets = np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(names[best].tolist(), pa.string()), pa.array(share),
                     pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    names=[*batch.schema.names, "lang_pred", "score", "lang_spans"])
    return run


def label(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and lang_spans (first word, word after the last, language)."""
    docs = docs.drop("lang_pred", "score", "lang_spans")
    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType())
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("lang_spans", T.ArrayType(span))])
    return in_batches(docs, _label(docs.sparkSession.sparkContext.broadcast(model)), schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and the number of spans; trained on the documents not held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return label(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))
