import random

import pyarrow.parquet as pq
import pytest
import zstandard

from plumbline.llm import quality


def test_counts_by_hand(spark):
    random.seed(1)
    prose = " ".join("".join(random.choice("etaoinshr") for _ in range(random.randint(2, 9))) for _ in range(400))
    noise = " ".join("".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(7)) for _ in range(300))
    lines = "a b c\n\n a b c\na b c\nx\nx \nx"
    rows = [(1, prose), (2, "same old words " * 200), (3, noise), (4, lines), (5, None), (6, ""), (None, "é# *$\x0b%\u00a0&|<> x"), (7, prose), (7, prose), (8, (prose + "\n") * 30)]
    got = {}
    for r in quality.judge(spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, raw int")).collect():
        got[r["doc_id"]] = r
    assert got[1]["kept"] and not got[1]["base_failed"] and got[1]["word_chars"] == len(prose.replace(" ", "")) and got[1]["n_repeat_words"] == 0
    assert got[2]["base_failed"] and got[2]["n_repeat_words"] == 600
    assert not got[3]["kept"] and not got[3]["base_failed"] and got[3]["ratio"] > 0.66
    assert got[4]["n_dup_lines"] == 2 and got[4]["n_words"] == 12
    assert got[5]["n_words"] == got[6]["n_words"] == 0 and got[5]["base_failed"]
    assert got[None]["n_words"] == 4 and got[None]["n_symbols"] == 8 and got[None]["word_chars"] == 11
    assert got[7]["kept"] and not got[8]["kept"]
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlapping_windows_count_words_once():
    words = "a b c a b c d".encode().split()
    assert quality.repeat_words(words) == 6
    assert quality.repeat_words(b"x x x x".split()) == 4
    assert quality.repeat_words(b"a b".split()) == 0


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_clean_prose_is_kept_at_any_length(lang):
    folder = "/root/testdata/sf0.1"
    clean = {r["doc_id"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["quality"] == 1}
    texts = sorted({r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist() if r["doc_id"] in clean and r["lang"] == lang})
    random.Random(3).shuffle(texts)
    raw, compress = "\n".join(texts).encode(), zstandard.ZstdCompressor(level=quality.LEVEL).compress
    assert all(quality.bands(raw[:size], compress)[0] for size in (50_000, 100_000, 300_000, 1_000_000, 1_300_000, len(raw)))


def test_every_byte_lies_in_a_chunk():
    rng, compress = random.Random(1), zstandard.ZstdCompressor(level=quality.LEVEL).compress
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(6000)).encode()
    assert quality.bands(prose[:12_288], compress)[2] == 0
    assert quality.bands(prose[:8_192] + b"ab " * 1_360, compress)[2] == 1
    assert quality.bands(b"ab " * 1_400, compress)[2] == 2
    assert not quality.bands(prose[:24_576] + (prose[:60] * 300)[:12_288], compress)[0]
