import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from canonry.llm import bpe

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module", params=[bpe.Encoder, bpe.QuickEncoder])
def own(request):
    return request.param(bpe.default_vocabulary())


def test_random_texts_encode_and_decode_as_the_library_does(own, library):
    rng = random.Random(5)
    parts = [*"  \n\n\t\r\u00a0\u3000abcdeEéñß漢😀'.,!#01½\0\x1c\x85\u200b", "<|endoftext|>", " the", "tion", "'s", "'ll", "edblehable"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        for text, mine, theirs in zip(part, own.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert mine.tolist() == theirs.ids, repr(text)
            assert own.decode(mine) == library.decode(theirs.ids, skip_special_tokens=False)


def test_long_words_and_texts(own, library):
    texts = ["ab" * 5000, "x" * 20000, "word " * 20000, "thon" * 300 + " " + "erin" * 300]
    for mine, theirs in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids


def test_check_of_pairs_agrees_with_merging(own):
    v = own.v
    rng = random.Random(3)
    usable = list(v.usable)
    import numpy as np

    pairs = [(rng.choice(usable), rng.choice(usable)) for _ in range(4000)]
    told = v._compatible(np.array([v.usable[a] for a, _ in pairs]), np.array([v.usable[b] for _, b in pairs]))
    for (a, b), good in zip(pairs, told, strict=True):
        assert good == (v.exact(a + b) == [v.usable[a], v.usable[b]])


def test_table_with_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "Hello there", "x"), (2, None, "x"), (3, "", None), (1, "Hello there", "x"), (None, "é", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digests(df).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.where(F.lit(False))).count() == 0
    back = {tuple(r) for r in bpe.encode_decode(df).select("doc_id", "decoded").collect()}
    assert back == {(k, t or "") for k, t, _ in rows}
