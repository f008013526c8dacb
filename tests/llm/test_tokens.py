"""Corpus encoding."""

import pytest

from eventide.llm import tokens

TEXTS = ["It's the patient's chart.", "", None, "   ", "\n\n  x\t", "naïve Größe 患者は安定しています。 😀", "a" * 5000, "don't  stop\r\nnow", "<|endoftext|> is text", "12,345.67 mg/dL", "ꟍ ა Ა new letters", "x" + " " * 300 + "y", "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "h") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, word string")


@pytest.mark.parametrize("words", [1, 7, tokens.BLOCK_WORDS])
def test_ids(spark, reference, monkeypatch, words):
    monkeypatch.setattr(tokens, "BLOCK_WORDS", words)  # a block per text, a few texts, all texts
    got = {r.doc_id: r.ids for r in tokens.encode(frame(spark, TEXTS), "doc_id", "text").collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in tokens.count(frame(spark, TEXTS), "text").collect()}
    assert counts == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


def test_round_trip(spark):
    encoded = tokens.encode(frame(spark, TEXTS), "doc_id", "text")
    assert {r.doc_id: r.text for r in tokens.decode(encoded, "doc_id").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    ids = spark.createDataFrame([(1, None), (2, []), (3, [64]), (3, [64])], "doc_id bigint, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in tokens.decode(ids, "doc_id").collect()) == [(1, None), (2, ""), (3, "a"), (3, "a")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        tokens.decode(spark.createDataFrame([(1, [64, 10**6])], "doc_id bigint, ids array<int>"), "doc_id").collect()


def test_repeats_and_empty(spark, reference):
    df = spark.createDataFrame([(1, "rare words here"), (1, "rare words here"), (1, "other"), (None, "rare words here")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.ids) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got == sorted([("1", reference("rare words here"))] * 2 + [("1", reference("other")), ("None", reference("rare words here"))])
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0 and tokens.count(df.limit(0), "text").count() == 0


def test_cut_joins_back():
    for t in filter(None, TEXTS):
        assert "".join(tokens.cut(t)) == t


def test_cut_is_the_tokenizers():
    from tokenizers import pre_tokenizers

    exact = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(map(chr, range(0x530)))
    for t in (every, " ".join(every), "'s 'll'x  \x85\xa0 y\x1c z", "".join(f"a{c}b {c} " for c in every)):
        assert tokens.cut(t) == [t[a:b] for _, (a, b) in exact.pre_tokenize_str(t)]
