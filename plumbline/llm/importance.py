"""Target-distribution importance resampling with hashed features and a position-table CRC.

Features of a text are its runs of 1 to `most` consecutive words, joined by one space, repeats counted; a
feature's bucket is the CRC-32 of its bytes modulo the number of buckets. Each bucket has a log gain from the
counts of the target texts over those of the corpus, a document's weight is the mean gain of its features,
and documents are drawn without replacement by adding seeded Gumbel noise to the weights.

A CRC is linear: apart from a constant that depends on the length alone, it is the exclusive or of one
contribution for each byte, which depends on the byte and on its distance from the end. The contributions
stand in a table of BLOCK distances, so that all features of a batch are hashed by one gather and one
`bitwise_xor.reduceat` over their spans. Longer spans are cut from their end into blocks of BLOCK bytes,
whose values are folded in pairs, the farther one shifted over the nearer one, in logarithmic rounds.

Counts cover all rows. What leaves the cluster is a count for each bucket; each task sums its buckets up
before the shuffle. Ranks come from a range partitioning with offsets, so no task sees all scores.

Defined results: a null or empty text, or one without words, has no features and the weight 0; a null
doc_id is drawn by the seed with no id behind it; repeated rows are scored and ranked each; equal scores go to the smaller
doc_id; without target texts all counts of the target are 0; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_of
from plumbline.operators.drift import indexed

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# The reversed polynomial of CRC-32 and the bytes of words.
POLYNOMIAL = 0xEDB88320
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))

BLOCK = 64
#: Bytes whose contributions are held at a time, and bytes of texts that are put together.
SLICE = 1 << 20

U = np.uint32


@functools.cache
def contributions() -> np.ndarray:
    """What a byte adds to the register, by its distance from the end (rows) and value (columns)."""
    first = np.arange(256, dtype=U)
    for _ in range(8):
        first = (first >> U(1)) ^ (U(POLYNOMIAL) * (first & U(1)))
    rows = [first]
    for _ in range(BLOCK - 1):
        rows.append(first[rows[-1] & U(255)] ^ (rows[-1] >> U(8)))
    return np.stack(rows)


def _shifted(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The register after the zero bytes that `by` stands for, a row for each of its four bytes."""
    return by[0][register & U(255)] ^ by[1][(register >> U(8)) & U(255)] ^ by[2][(register >> U(16)) & U(255)] ^ by[3][register >> U(24)]


@functools.cache
def _shift(level: int) -> np.ndarray:
    """The table that shifts a register by BLOCK << level zero bytes."""
    if not level:
        return contributions()[BLOCK - 1 : BLOCK - 5 : -1]
    half = _shift(level - 1)
    return _shifted(half, half)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many zero bytes, which holds the register's start and its final complement."""
    starts = [0xFFFFFFFF]
    first = contributions()[0]
    for _ in range(BLOCK - 1):
        starts.append(int(first[starts[-1] & 255]) ^ (starts[-1] >> 8))
    register = np.array(starts, U)[lengths % BLOCK]
    blocks = lengths // BLOCK
    for level in range(int(blocks.max(initial=0)).bit_length()):
        on = np.flatnonzero((blocks >> level) & 1)
        register[on] = _shifted(register[on], _shift(level))
    return ~register


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _block_values(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The exclusive or of the contributions of each span of 1 to BLOCK bytes."""
    lengths = ends - starts
    at = _spread(starts, lengths)
    away = np.repeat(ends - 1, lengths) - at
    return np.bitwise_xor.reduceat(contributions().ravel()[(away << 8) | raw[at]], np.cumsum(lengths) - lengths)


def crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of `raw` (uint8); spans hold at least one byte and may overlap."""
    lengths = ends - starts
    values = np.zeros(len(starts), U)
    short = np.flatnonzero(lengths <= BLOCK)
    parts = np.cumsum(lengths[short]) // SLICE
    for own in np.split(short, np.flatnonzero(np.diff(parts)) + 1) if len(short) else ():
        values[own] = _block_values(raw, starts[own], ends[own])
    for i in np.flatnonzero(lengths > BLOCK):
        values[i] = _folded(raw, int(starts[i]), int(ends[i]))
    return values ^ length_constants(lengths)


def _folded(raw: np.ndarray, start: int, end: int) -> int:
    """The exclusive or of the contributions of one long span, block by block from its end."""
    stops = np.arange(end, start, -BLOCK)
    level, values = 0, np.concatenate([_block_values(raw, np.maximum(own - BLOCK, start), own) for own in np.split(stops, range(SLICE // BLOCK, len(stops), SLICE // BLOCK))])
    while len(values) > 1:
        near, far = values[::2].copy(), values[1::2]
        near[: len(far)] ^= _shifted(far, _shift(level))
        level, values = level + 1, near
    return int(values[0])


class Features:
    """The features of some texts: `text` (its number) and `bucket` of each, and the words of each text."""

    def __init__(self, texts: list[bytes], most: int, buckets: int) -> None:
        raw = np.frombuffer(b" ".join([*texts, b""]).lower() or b" ", np.uint8)
        is_word = np.zeros(256, bool)
        is_word[np.frombuffer(WORD_BYTES, np.uint8)] = True
        inside = is_word[raw]
        turns = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = turns[::2], turns[1::2]
        lasts = np.cumsum(np.array([len(text) + 1 for text in texts], dtype=np.int64))
        of = np.searchsorted(lasts, starts, "right")
        self.words = np.bincount(of, minlength=len(texts))
        if most > 1:  # words with one space behind each
            inside[ends] = True
            kept = np.cumsum(inside) - 1
            spaced = raw.copy()
            spaced[ends] = 32
            raw, starts, ends = spaced[inside], kept[starts], kept[ends]
        found, buckets_of = [of[:0]], [of[:0]]
        for n in range(1, most + 1):
            whole = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else of[:0]
            found.append(of[whole])
            buckets_of.append(crcs(raw, starts[whole], ends[whole + n - 1]).astype(np.int64) % buckets)
        self.text, self.bucket = np.concatenate(found), np.concatenate(buckets_of)


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in bytes) of at most about SLICE bytes; a longer text is a portion of its own."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if held and size + len(raw) > SLICE:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all `texts` (text) each bucket has; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows in batches:
            for _, portion in _portions(rows["text"]):
                total += np.bincount(Features(portion, most, buckets).bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select(text_of("text").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, target over corpus; `buckets` numbers in all."""
    counts = bucket_counts(target, most, buckets).select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s")).unionByName(bucket_counts(corpus, most, buckets).select("bucket", F.lit(0).cast("long").alias("t"), F.col("n").alias("s")))
    found = counts.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s")).orderBy("bucket").toArrow()
    t, s = np.zeros(buckets), np.zeros(buckets)
    at = found["bucket"].to_numpy()
    t[at], s[at] = found["t"].to_numpy(), found["s"].to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first, portion in _portions(rows["text"]):
                features = Features(portion, most, len(gain))
                n = np.bincount(features.text, minlength=len(portion))
                total = np.bincount(features.text, gain[features.bucket], len(portion)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"].slice(first, len(portion)), pa.array(features.words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank, 1 and up for the drawn ones in order of score, else null.

    Of the documents of at least `least_words` words `percent` in a hundred are drawn, so that they are like `target` (text).
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = durable(weights(documents, gains(documents, target, most, buckets), most).withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least_words).withColumn("__down", -F.col("score"))
    drawn = able.count() * percent // 100
    ranked = indexed(able, ["__down", "doc_id", "n_features"], "__at").withColumn("rank", F.when(F.col("__at") < drawn, F.col("__at") + 1))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(out).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(out))


ORACLE_SQL = r"""
with recursive steps as (
  select range::bigint as byte, range::bigint as c, 0 as k from range(256)
  union all
  select byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc_table as materialized (select list(c order by byte) as entries from steps where k = 8),
texts as (
  select 0 as side, doc_id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark),
words as materialized (
  select side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts),
buckets as materialized (
  select word, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1]))) % 10000 as bucket
  from (select distinct word from words) cross join crc_table),
counts as materialized (
  select bucket, count(*) filter (side = 0)::double as s, count(*) filter (side = 1)::double as t from words join buckets using (word) group by bucket),
totals as (select sum(s) as all_s, sum(t) as all_t from counts),
gains as materialized (
  select bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint as gain from counts cross join totals),
weighed as (
  select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from words join buckets using (word) join gains using (bucket) where side = 0 group by doc_id),
scored as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from documents d left join weighed w on d.doc_id = w.doc_id),
ranked as (
  select doc_id, n_features, weight, score, n_features >= 20 as able,
         row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when able and place <= n * 10 // 100 then place end as rank from ranked
"""
