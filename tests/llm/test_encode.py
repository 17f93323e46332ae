import os
import random

import pytest

from corpusloom.llm import encode as E

PATH = os.path.join(E.TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=E.WORDS, mergeable_ranks=E.Bpe.of(PATH).ranks, special_tokens={})


def ids(text):
    from array import array

    out = array("i")
    E.Bpe.of(PATH).encode_into(text, out)
    return list(out)


def test_against_library():
    r, enc = random.Random(0), reference()
    texts = ["", " ", "Hello world's", "<|endoftext|>", "naïve—été 42\r\n\t x", "汉字和 emoji 👩🏽‍💻", "\u0000﻿‮", "a" * 255, "ab" * 4000, "É" * 700]
    texts += ["".join(r.choice("abcde é汉'\n0") for _ in range(r.randrange(500))) for _ in range(60)]
    for t in texts:
        assert ids(t) == enc.encode_ordinary(t)
        assert bytes(b for i in ids(t) for b in enc.decode_single_token_bytes(i)).decode() == t


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello", 9), (2, None, 9), (3, "", 9), (4, "Hello", 9)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in E.encode(df).collect()}
    assert got == {1: ids("Hello"), 2: [], 3: [], 4: ids("Hello")}
    assert E.encode(df.limit(0)).count() == 0
    assert E.encode(df).schema["ids"].dataType.simpleString() == "array<int>"
