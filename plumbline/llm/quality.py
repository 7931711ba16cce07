"""Quality rules: counts of words, symbols and repetitions, and bands of zstandard compression ratios.

A text's ratio is its compressed size over its size in UTF-8. Repetitive text compresses too well,
random or encoded text too badly; how well plain prose compresses depends on its length, so the limits
do too. Whole texts are judged by the band of their size, and their fixed chunks by the chunk band: a
text is rejected when more than `CHUNK_SHARE` of its chunks fall outside. The last chunk ends with the
text, and so may share bytes with the one before; every byte from the first full chunk on is looked at.

Defined results: a null text counts as empty; an empty text has no words, so it fails the base rules;
texts below the first band's size are judged by the base rules alone; repeated rows are judged each on
their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

#: (from this many bytes on, least ratio, greatest ratio). Joined clean texts in four languages come down to 0.359 at 60 KB,
#: 0.355 at 100 KB, 0.358 at 300 KB and 0.335 at 1 MB and more, where the window of the compressor ends the fall.
BANDS = ((200, 0.42, 1.00), (500, 0.41, 0.85), (1_000, 0.40, 0.75), (2_000, 0.40, 0.70), (4_000, 0.38, 0.66), (10_000, 0.365, 0.64), (30_000, 0.35, 0.62), (100_000, 0.33, 0.62), (300_000, 0.32, 0.62), (1_000_000, 0.30, 0.62), (3_000_000, 0.28, 0.62))
CHUNK_BYTES = 4_096
CHUNK_BAND = (0.25, 0.70)
CHUNK_SHARE = 0.2
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside long"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(covered, at)
            covered = at + 3
    return total


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(text.split(b"\n"))
    return sum(times - 1 for line, times in counts.items() if times > 1 and line.split())


def code_points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


def bands(raw: bytes, compress) -> tuple[bool, float | None, int]:
    """Whether a text lies within its bands, its ratio and how many chunks lie outside theirs."""
    band = next((b for b in reversed(BANDS) if len(raw) >= b[0]), None)
    if band is None:
        return True, None, 0
    ratio = len(compress(raw)) / len(raw)
    starts = [*range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if starts and len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    outside = sum(not CHUNK_BAND[0] <= len(compress(raw[at : at + CHUNK_BYTES])) / CHUNK_BYTES <= CHUNK_BAND[1] for at in starts)
    return band[1] <= ratio <= band[2] and outside <= CHUNK_SHARE * len(starts), ratio, outside


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    names = [column.split()[0] for column in COLUMNS.split(", ")]
    for rows in batches:
        out: list[list] = [[] for _ in names[1:]]
        for text in rows["raw"]:
            raw = text.as_py()
            words = raw.split()  # of bytes: runs of anything but the six ASCII white space characters
            n_repeat = repeat_words(words)
            failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
            good, ratio, outside = bands(raw, compress)
            row = len(words), code_points(b"".join(words)), len(raw) - len(raw.translate(None, SYMBOLS)), dup_lines(raw), n_repeat, failed, not failed and good, ratio, outside
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], *map(pa.array, out, kinds)], names)


def judge(documents: DataFrame) -> DataFrame:
    """Per document its base counts, base_failed and kept (see the module's docstring)."""
    return documents.select(F.col("doc_id").cast("long"), text_of("text").cast("binary").alias("raw")).mapInArrow(_judge, COLUMNS)
