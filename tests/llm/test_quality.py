"""Text quality."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import quality

PROSE = "The patient was admitted to the burn center with septic shock and was moved to a monitored bed. He slept poorly but denied pain, and the night team helped him sit at the edge of the bed.\nNo bleeding was seen around the nasal cannula,\nand the dressing was changed without difficulty."
LIST = "\n".join(f"- heparin titration x{i}\n- labs at six ok" for i in range(9))
CASES = {
    PROSE: True, PROSE.upper(): True, LIST: False, "00:30\t84.5\t16.1\n01:30\t90.1\tok\n" * 9: False, "END OF LINE\n" * 30: False, "void " * 60: False, "____\n########\n" * 9: False,
    "diet order, labs at six, filter check bed 12, propofol 5 mg IV, chest x-ray, pump exchange kit, wean sedation": False, "CDKKwQ3emfPmLpW23PVSugJIsirzV00YdDjBi1e8R8mKRc3l1zVR5IvrjhRmhlSY\n" * 5: False,
    "2024-06-05T00:45:00 DEBUG rpm=929 lactate=83.0\n" * 9: False, "Una segunda lectura, tomada 34 minutos más tarde, fue normal. El paciente durmió poco, pero no tuvo dolor.": True,
    "患者は安定しています。家族に説明しました。": True, "shock sepsis icu ecmo oxygen filter unit pump lactate ecmo sedation icu oxygen bed shock ventilator pump": False, PROSE + "\n" + LIST * 4: False, PROSE * 4 + "\n" + LIST: True,
    None: None, "": None, " \n\t": None,
}




def hashes(words):
    page = quality._Page([(w, 0, len(w)) for w in words.split()])
    return np.unique(page.word_hash)


COMMON = hashes("the and was of in to a an but no not on at it is that for with by from as were una un de el la que fue no pero tuvo más")


def test_verdicts(spark):
    texts = list(CASES)
    cases = spark.createDataFrame([(i, t, "es" if (t or "").startswith("Una") else "en", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, n_chars bigint")
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((-1 - F.col("doc_id")).alias("doc_id"), "text", "lang", "n_chars")
    rows = {r.doc_id: r for r in quality.statistics(cases.unionByName(corpus), "doc_id", "text", "lang").where("doc_id >= 0").collect()}
    assert {texts[i]: r.is_prose for i, r in rows.items()} == CASES
    r = rows[0]
    assert r.n_chars == len(PROSE) and r.n_lines == 3 and r.n_lines_punct == 2 and abs(r.common_word_share - r.n_common / r.n_words) < 1e-12
    assert rows[texts.index("")].mean_word_length is None
    assert quality.statistics(cases.limit(0), "doc_id", "text").count() == 0


def odd_texts():
    rnd = random.Random(5)
    pieces = ["the", "a", "don't", "well-known", "--", "-", "'", "’", " ", "  ", "\n", "\r", "\r\n", "\u2028", "\x85", "7", ".", "x" * 40, "été", "İ", "a) ", "(12) ", "[x] ", "|", "\t", ",", "Ã¤", "â€œ", "。", "患者", ": ", "k" * 400]
    texts = ["".join(rnd.choice(pieces) for _ in range(300)) for _ in range(60)]
    parts = [PROSE, LIST, "A short line.", "x" * 30, "Name: value", "the flow of the unit was checked by the nurse and", "yes", "\tcell\tcell"]
    texts += ["\n".join(rnd.choice(parts) for _ in range(60)) for _ in range(12)]
    texts += ["word " * 900, "The bed was moved. " * 300, "first\rsecond.\r" * 200, "z" * 3000, "the-" * 900, "-" * 3000, " " * 2000 + "a.", "\n" * 900 + "- x\n" * 50]
    return texts


@pytest.mark.parametrize("chunk", [1, 7, 64, 700])
def test_chunks_give_the_whole(monkeypatch, chunk):
    texts = odd_texts()
    whole = [quality.measure(t, COMMON) for t in texts]  # one chunk but for the longest
    monkeypatch.setattr(quality, "CHUNK", 10**9)
    assert whole == [quality.measure(t, COMMON) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", chunk)
    for t, w in zip(texts, whole):
        parts, _ = quality.summaries(quality._chunks(t), COMMON)
        left = functools.reduce(quality.merge, parts)
        right = functools.reduce(lambda b, a: quality.merge(a, b), parts[::-1])
        assert left == right
        assert quality.close(left) == w, (chunk, t[:60])


def test_counts_by_hand():
    text = "Don't stop; it's 5 o'clock.\r\n\r\nThe end\rAgain!"
    got = dict(zip(quality.COUNTS, quality.measure(text, hashes("the it don"))))
    assert {k: got[k] for k in quality.COUNTS[:8]} == {
        "n_chars": len(text), "n_words": 7, "n_word_chars": 5 + 4 + 4 + 7 + 3 + 3 + 5, "n_common": 3, "n_symbols": 6, "n_digits": 1, "n_lines": 3, "n_lines_punct": 2,
    }


def test_every_length_takes_the_tree(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 90)
    monkeypatch.setattr(quality, "FAN", 3)  # all levels merge, and the top one more than it would
    monkeypatch.setattr(quality, "LEVELS", 9)
    monkeypatch.setattr(quality, "common_words", lambda df, *_: df.sparkSession.createDataFrame([(int(x),) for x in COMMON.view(np.int64)], "word bigint"))
    texts = [*odd_texts(), None, "", "  "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, PROSE, "x")], "doc_id bigint, text string, state string")
    rows = quality.statistics(df, "doc_id", "text").collect()
    want = [(i, *quality.measure(t or "", COMMON)) for i, t in enumerate(texts)]
    want += [want[0], (None, *quality.measure(PROSE, COMMON))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, *[r[c] for c in quality.COUNTS])) for r in rows)


def test_common_words_are_learned(spark):
    rows = [(f"Der Patient schlief in der Nacht gut und die Familie kam um {i} Uhr zu Besuch.", "de") for i in range(40)]
    rows += [("bett pumpe filter bett pumpe filter nacht nacht nacht", "de")] * 60 + [("The unit was closed at night and the team was told of it.", None)] * 5
    words = quality.common_words(spark.createDataFrame(rows, "text string, lang string"), "text", "lang").collect()
    of = lambda lang: {r.word for r in words if r.lang == lang}
    key = lambda w: set(hashes(w).view(np.int64).tolist())
    assert key("der und die in") <= of("de") and key("the and of") <= of(None)
    assert not key("nacht") & of("de") and not key("bett") & of("de")
