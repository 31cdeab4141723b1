"""Token ids against the public libraries that read the same vocabulary."""

import base64
import os
import random

import pytest

from frameloom.llm.tokens import TOKENIZER_FOLDER, VOCABULARY, WORD_PATTERN, ByteBpe, count_tokens, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZER_FOLDER, VOCABULARY)), reason="no vocabulary files")


def texts():
    rng = random.Random(1)
    out = ["", "a" * 3000, "==" * 2000, " " * 700, "<|endoftext|> x", "\x00\x01�", "ab" * 999, "don't we'll I'D\r\n\t x"]
    out += ["".join(rng.choice("abcdeéxyz漢") for _ in range(20_000)), "a" * 9999, "abab" * 3000 + "c", "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000))]
    out += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(200)) for _ in range(50)]
    out += ["".join(rng.choice("abcde 01,.é漢😀ه") for _ in range(500)) for _ in range(50)]
    return out


def test_ids_equal_the_library(spark):
    import tiktoken

    with open(os.path.join(TOKENIZER_FOLDER, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(900, None, "x"), (900, None, "x"), (None, "hi", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_corpus(df).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, library.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in got) == want
    counted = count_tokens(df, ["doc_id", "ids"]).collect()
    assert sorted(r["tokens"] for r in counted) == sorted(len(ids) for _, ids in want)


def test_a_small_cache_changes_nothing(monkeypatch):
    from frameloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    path = os.path.join(TOKENIZER_FOLDER, VOCABULARY)
    small, large = ByteBpe(path), ByteBpe.load(path)
    for t in texts()[5:12]:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_corpus(df).count() == 0
    assert count_tokens(df, ["doc_id"]).count() == 0
