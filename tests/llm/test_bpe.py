import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symscape.llm import bpe
from tests.llm import made


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'’sdtlvmreab1²%#@é  　\x1c\x85"))), min_size=1, max_size=8))
def test_tokens_are_those_of_whole_texts(texts):
    own = bpe.tokenizer()
    tokens, offsets = own.encode(texts)
    for i, t in enumerate(texts):
        assert tokens[offsets[i] : offsets[i + 1]].tolist() == own.encoding.encode_ordinary(t)
    assert [p.decode() for p in own.decode(tokens, offsets)] == texts


def test_long_text_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own, rng = bpe.Tokenizer(), random.Random(2)
    for _ in range(3):
        text = made.words(rng, 3000)
        tokens, offsets = own.encode(["", text, ""])
        assert tokens.tolist() == own.encoding.encode_ordinary(text) and offsets.tolist() == [0, 0, len(tokens), len(tokens)]


def test_cuts_are_in_no_token():
    own = bpe.tokenizer()
    cut = own.cut_pairs.reshape(256, 256)
    assert cut.sum() > 5000
    inside = {(t[i], t[i + 1]) for t in (own.bytes[a : a + n].tobytes() for a, n in zip(own.starts, own.lengths, strict=True)) for i in range(len(t) - 1)}
    assert not any(cut[p] for p in inside)


def test_round_trip_of_a_table(spark):
    docs = spark.createDataFrame(made.odd(), made.DOCS)
    got = bpe.encoded(docs)
    assert got.count() == docs.count()
    assert made.rows(bpe.decoded(got)) == made.rows(docs.select("doc_id", "text"))
    assert got.where("tokens IS NULL").count() == docs.where("text IS NULL").count()
    assert made.rows(got.select("doc_id", "md5", "n_bytes")) == made.rows(docs.selectExpr("doc_id", "md5(text)", "octet_length(text)"))
    assert bpe.encoded(docs.limit(0)).count() == 0
    assert np.all([r.n_tokens == len(r.tokens) for r in got.where("tokens IS NOT NULL").collect()])


def test_decoding_of_what_is_no_token(spark):
    own = bpe.tokenizer()
    a, b = own.encoding.encode_ordinary("one")[0], own.encoding.encode_ordinary(" two")[0]
    rows = [(1, [a, None, b]), (2, [-1]), (3, [a, 10**9, b]), (4, []), (5, None), (6, [2**40]), (7, own.encoding.encode_ordinary("\u00e9")[:1]), (8, [len(own.lengths) - 1]), (None, [a])]
    got = {r.doc_id: r.text for r in bpe.decoded(spark.createDataFrame(rows, "doc_id long, tokens array<long>")).collect()}
    assert got == {1: "one\ufffd two", 2: "\ufffd", 3: "one\ufffd two", 4: "", 5: None, 6: "\ufffd", 7: got[7], 8: "\ufffd", None: "one"}
    assert got[7] in ("\u00e9", "\ufffd")
    assert bpe.decoded(spark.createDataFrame([(1, [a])], "doc_id long, tokens array<int>")).first().text == "one"
