"""Languages in scripts beyond the listed ranges, in the operator and in the pipeline's stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import language, stages

EN = "the and of that thing with for from house water people year because they work again"
# Two languages in Ethiopic and one language each in scripts of three and four bytes.
OWN = {
    "te": "నేను ఇల్లు నీరు మనిషి పని రోజు పుస్తకం పాట చెట్టు ఊరు", "kn": "ನಾನು ಮನೆ ನೀರು ಮನುಷ್ಯ ಕೆಲಸ ದಿನ ಪುಸ್ತಕ ಹಾಡು ಮರ ಊರು",
    "am": "ሰላም ቤት ውሃ ሰው ሥራ ቀን መጽሐፍ ዛፍ ከተማ ነው", "ti": "ከመይ ገዛ ማይ ሰብ ዕዮ መዓልቲ ደርፊ ኦም ዓዲ እዩ",
    "km": "ខ្ញុំ ផ្ទះ ទឹក មនុស្ស ការងារ ថ្ងៃ សៀវភៅ ចម្រៀង ដើមឈើ ភូមិ", "ff": "𞤬𞤵𞤤 𞤨𞤵𞤤 𞤢𞤣 𞤤𞤢𞤥 𞤲𞤣𞤭 𞤥𞤭 𞤮 𞤫𞤲 𞤸𞤫 𞤲𞤮",
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    kinds = {"en": EN, **OWN}
    rows = [(i, " ".join(rng.choice(kinds[x].split(), 30)), x) for i, x in enumerate(list(kinds) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_languages_in_unlisted_scripts(spark, docs):
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r.lang for r in got} == {"en", *OWN} and all(r.lang_pred == r.lang and r.score >= 0.9 for r in got)
    kept = stages.known_language(docs)
    assert kept.count() == docs.count()
    mixed = docs.where("lang = 'te'").withColumn("text", F.concat(F.lit("the "), "text")).limit(3)
    model = language.train(docs)
    assert {r.lang_pred for r in language.label(mixed, model).collect()} == {"te"}


def test_a_script_that_no_language_uses_stays_unknown(spark, docs):
    model = language.train(docs.where("lang <> 'kn'"))
    got = language.label(docs.where("lang = 'kn'"), model).collect()
    assert all(r.score == 0 for r in got)


def test_signs_speak_for_no_script():
    signs = "— “ ” … € µ º ª ʻ ’ 1 ! · ﬀ".split()
    code = [language._SCRIPT[ord(c)] for c in signs]
    assert not any(code[:-1]) and language.SCRIPT_NAMES[code[-1] - 1] == "Latin"
