import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe
from plumbline.llm.queries import RANKS

SCHEMA = "doc_id long, text string"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows():
    random.seed(1)
    odd = "".join(random.choice(" \n'slledt1!é漢 \x1c") for _ in range(8_000))
    return [(None, "a b"), (1, None), (2, ""), (3, "x" * 3_000), (4, "don't  \n\n we'll  日本語 １２ ½ʼ " * 200), (5, "\n \t " * 500), (6, odd), (6, "dup"), (6, "dup"), (7, "  a" * 1_000 + "z" * 1_000 + " bc" * 900)]


@pytest.mark.parametrize("chunk, overlap", [(700, 60), (97, 13), (bpe.CHUNK, bpe.OVERLAP)])
def test_like_the_library_at_any_chunk_size(spark, chunk, overlap):
    encoding = library()

    def expected(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = sorted(map(tuple, bpe.encode_digests(spark.createDataFrame(rows(), SCHEMA), RANKS, chunk, overlap).collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t in rows()), key=str)


def test_round_trip(spark):
    ids = bpe.encode(spark.createDataFrame(rows(), SCHEMA), RANKS, 97, 13)
    got = sorted(map(tuple, bpe.decode(ids, RANKS).collect()), key=str)
    assert got == sorted(((i, t or "") for i, t in rows()), key=str)


def test_a_run_without_boundary_is_not_cut(spark):
    text = "ab cd " + "q" * 900 + " ef gh" * 50
    long = spark.createDataFrame([("u", text)], "uid string, piece string")
    starts = bpe.seams(long, 100, 20).first()["starts"]
    assert starts[0] == 0 and all(at < 120 for at in starts)


def test_empty_and_extra_columns(spark):
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA + ", uid int, piece int, ids int"), RANKS).count() == 0
    frame = spark.createDataFrame([(1, "a", 3, 4)], SCHEMA + ", uid int, piece int")
    assert bpe.encode_digests(frame, RANKS).first()["n_tokens"] == 1


def test_a_very_long_text_takes_time_in_proportion(spark):
    text = "it's a long text, isn't it? 1234 \n" * 60_000
    got = bpe.encode_digests(spark.createDataFrame([(1, text)], SCHEMA), RANKS).first()
    ids = library().encode_ordinary(text)
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
