import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sameword.llm.bpe import Bpe, decode_ids, default_vocabulary, encode_texts


@pytest.fixture(scope="module")
def bpe():
    return Bpe(default_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def same(bpe, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text).tolist() == ids, text[:80]
    assert bpe.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_texts_as_the_library_encodes_them(bpe, library):
    for text in ["", " ", "a", "Hello world's  end\n\n x", "<|endoftext|>a <|endoftext|> b<|endoftext|>", "éèß 漢字   x 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaa", "\t\t\x1c\x85 q", "thththththerererere" * 50]:
        same(bpe, library, text)


def test_random_words(bpe, library):
    r = random.Random(1)
    for _ in range(3000):
        same(bpe, library, "".join(r.choice("abeintrhsABé ☃'0\n") for _ in range(r.randint(1, 40))))
    tokens = [t.decode("utf-8", "ignore") for t in bpe.tokens]
    for _ in range(3000):
        same(bpe, library, "".join(r.choice(tokens) for _ in range(r.randint(1, 5))))


def test_every_code_point(bpe, library):
    """Each of them between letters, after a space and before a number, as the library splits and merges it."""
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(letters), 2000):
        text = "".join(f"{c}a{c} {c}1" for c in letters[i : i + 2000])
        ids = library.encode(text, add_special_tokens=False).ids
        if bpe.encode(text).tolist() != ids:  # which one
            for c in letters[i : i + 2000]:
                same(bpe, library, f"{c}a{c} {c}1")
        assert bpe.encode(text).tolist() == ids


def test_rows(spark, library):
    rows = [(1, "Some text, twice."), (2, None), (3, ""), (4, "Some text, twice."), (5, "é" * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n_tokens", "'x' as token_ids")
    got = {r.id: r for r in encode_texts(docs).collect()}
    for i, text in rows:
        assert got[i].token_ids == library.encode(text or "", add_special_tokens=False).ids
    back = {r.id: r.text for r in decode_ids(encode_texts(docs)).collect()}
    assert back == {i: text or "" for i, text in rows}
    assert encode_texts(docs.where("doc_id < 0")).count() == 0
