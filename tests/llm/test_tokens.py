"""The cached tokeniser against the library, character by character."""

import pytest

from tarnweb.llm import token_files, tokens


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_character(vocabulary):
    own = tokens.Pieces(vocabulary)
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    for a in range(0, len(chars), 4096):
        texts = [t for c in chars[a : a + 4096] for t in (c, f"ab{c}cd Ef", f"ab {c} cd\n{c}{c}x")]
        ids, counts = own.encode(texts)
        want = own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert counts.tolist() == [len(e.ids) for e in want]
        assert ids.tolist() == [i for e in want for i in e.ids]


def test_letters_taken_apart(spark):
    """A text whose lower case has more characters, beside others and alone."""
    texts = ["İstanbul is big", "plain words", "İİ", "xİ y", None, ""]
    table = tokens.whole(token_files.VOCABULARY)
    got = token_files.encode_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    want = {i: len(table.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want
