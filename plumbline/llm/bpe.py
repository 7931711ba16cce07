"""Byte-level BPE encoding and decoding of whole texts.

A text is split by a pre-token pattern and each match is merged by rank on its own, so a text can be
cut at any pre-token boundary. Long texts are cut into overlapping chunks that are pre-tokenised in
parallel. A chunk starts at an arbitrary character, so its first boundaries may be false; the pattern
never looks behind, so from the first boundary that two neighbouring chunks share they agree for good.
There the chunks are stitched, and the pieces between the seams are encoded in parallel.

Defined results: a null or empty text has no tokens and decodes to the empty text; texts of any length
are encoded whole; repeated rows and repeated ids each get their own row; an empty table gives an empty
result. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import text_of

CHUNK = 32_768
OVERLAP = 1_024
#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 1 << 20

# Letters, numbers and white space of Unicode below U+0250.
LOW_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LOW_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LOW_SPACE = "\t-\r \x85\xa0"
#: The public pattern, spelled out for texts without characters from U+0250 on.
LOW_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LOW_LETTERS}]+| ?[{LOW_NUMBERS}]+| ?[^{LOW_SPACE}{LOW_LETTERS}{LOW_NUMBERS}]+|[{LOW_SPACE}]+(?![^{LOW_SPACE}])|[{LOW_SPACE}]+"


class PreTokenizer:
    """Splits texts by the public pattern; most texts take the quicker low-range form of it."""

    def __init__(self) -> None:
        import public_tokenizers
        import regex

        self.low, self.high, self.any = re.compile(LOW_PATTERN), re.compile("[^\0-ɏ]"), regex.compile(public_tokenizers.PATTERN)

    def pattern(self, text: str):
        return self.any if self.high.search(text) else self.low

    def split(self, text: str) -> list[str]:
        return self.pattern(text).findall(text)

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens."""
        return [m.end() for m in self.pattern(text).finditer(text)]


class _IdsText(dict):
    """Pre-token to its ids in decimal, joined by commas."""

    def __init__(self, codec: "Codec") -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        text = self[piece] = ",".join(map(str, self.codec.merge(piece)))
        return text


class _Raw(dict):
    """Ids in decimal, joined by commas, to the raw bytes that they stand for."""

    def __init__(self, codec: "Codec") -> None:
        self.codec = codec

    def __missing__(self, ids: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = self[ids] = b"".join(map(self.codec.bytes_of.__getitem__, map(int, ids.split(","))))
        return raw


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.splitter, self.ids_text, self.raw = PreTokenizer(), _IdsText(self), _Raw(self)

    def encode(self, text: str) -> list[str]:
        """One entry a pre-token: its ids in decimal, joined by commas."""
        return list(map(self.ids_text.__getitem__, self.splitter.split(text)))

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest_texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for rows in batches:
        counts, ids_digests, decoded_digests = [], [], []
        for text in rows["piece"]:
            found = own.encode(text.as_py())
            ids = ",".join(found)
            counts.append(ids.count(",") + 1 if ids else 0)
            ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded_digests.append(hashlib.sha256(own.decode(found)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode_texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids and decoded bytes of each piece."""
    own = codec(path)
    for rows in batches:
        found = [own.encode(text.as_py()) for text in rows["piece"]]
        yield pa.RecordBatch.from_arrays([rows["uid"], rows["no"], pa.array([",".join(ids) for ids in found], pa.string()), pa.array([own.decode(ids) for ids in found], pa.binary())], ["uid", "no", "ids", "decoded"])


def _chunk_boundaries(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Boundaries of each chunk in the part that it shares with the one before and with the one after.

    A boundary after white space is left out, as white space is split by what follows it, and so is
    what ends within two characters of the chunk's end, where the pattern could not look further.
    """
    splitter = PreTokenizer()
    for rows in batches:
        heads, tails = [], []
        for at, text in zip(rows["at"].to_pylist(), rows["piece"].to_pylist()):
            good = [end for end in splitter.boundaries(text) if not text[end - 1].isspace()]
            heads.append([at + end for end in good if end <= overlap])
            tails.append([at + end for end in good if chunk <= end < len(text) - 1])
        places = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([rows["uid"], rows["at"], pa.array(heads, places), pa.array(tails, places)], ["uid", "at", "head", "tail"])


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The overlapping chunks of each text, cut in one pass."""
    for rows in batches:
        for uid, text in zip(rows["uid"], rows["piece"].to_pylist()):
            at = [*range(0, max(1, len(text) - overlap), chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(at)), pa.array(at, pa.int32()), pa.array([text[start : start + chunk + overlap] for start in at])], ["uid", "at", "piece"])


def _cut_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text between its seams, cut in one pass."""
    for rows in batches:
        for uid, text, starts in zip(rows["uid"], rows["piece"].to_pylist(), rows["starts"].to_pylist()):
            pieces = [text[start:stop] for start, stop in zip(starts, [*starts[1:], len(text)])]
            yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces)], ["uid", "no", "piece"])


def seams(long: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(uid, starts): for each text of `long` (uid string, piece) the places where pieces begin, 0 first.

    Where two chunks share no boundary in their overlap (a run without a boundary that is longer than
    the overlap) nothing vouches for the later chunks, so the text is not cut from there on.
    """
    chunks = long.select("uid", "piece").mapInArrow(lambda batches: _cut(batches, chunk, overlap), "uid string, at int, piece string").repartition("uid", "at")
    found = chunks.mapInArrow(lambda batches: _chunk_boundaries(batches, chunk, overlap), "uid string, at int, head array<int>, tail array<int>")
    order = Window.partitionBy("uid").orderBy("at")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    cut = found.select("uid", "at", F.when(F.col("at") == 0, 0).otherwise(shared).alias("cut"))
    cut = cut.withColumn("sure", F.min(F.col("cut").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.filter("sure").groupBy("uid").agg(F.sort_array(F.collect_list("cut")).alias("starts"))


def encode_pieces(long: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(uid, no, ids, decoded) for the pieces of each text of `long` (uid string, piece), in order of no.

    ids holds the piece's token ids in decimal, joined by commas; decoded the bytes they stand for.
    """
    parted = long.join(seams(long, chunk, overlap), "uid").select("uid", "piece", "starts").mapInArrow(_cut_at, "uid string, no int, piece string")
    return parted.repartition("uid", "no").mapInArrow(lambda batches: _encode_texts(batches, path), "uid string, no int, ids string, decoded binary")


def _long_texts(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows of `texts` to be cut; equal texts share a uid and are encoded once."""
    return texts.filter(F.length("piece") > chunk + overlap).withColumn("uid", F.sha2("piece", 256))


def encode_digests(documents: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, digests of the decimal ids joined by commas and of the decoded bytes."""
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("piece"))
    whole = texts.filter(F.length("piece") <= chunk + overlap).mapInArrow(lambda batches: _digest_texts(batches, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    long = _long_texts(texts, chunk, overlap)
    pieces = encode_pieces(long.dropDuplicates(["uid"]).select("uid", "piece"), path, chunk, overlap)
    ordered = pieces.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("no", "ids", F.col("decoded").cast("string").alias("decoded")))).alias("parts"))
    joined = ordered.select("uid", F.array_join("parts.ids", ",").alias("ids"), F.array_join("parts.decoded", "").alias("decoded"))
    digests = joined.select("uid", (F.length("ids") - F.length(F.translate("ids", ",", "")) + 1).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return whole.unionByName(long.select("doc_id", "uid").join(digests, "uid").drop("uid"))


def encode(documents: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id and ids, the array of the whole text's token ids."""
    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("piece"))
    numbers = lambda column: F.when(F.length(column) > 0, F.split(column, ",").cast("array<int>")).otherwise(F.array().cast("array<int>")).alias("ids")
    short = texts.filter(F.length("piece") <= chunk + overlap).select("doc_id", F.col("doc_id").cast("string").alias("uid"), F.lit(0).alias("no"), "piece")
    whole = short.mapInArrow(lambda batches: _encode_rows(batches, path), "doc_id long, ids string").select("doc_id", numbers("ids"))
    long = _long_texts(texts, chunk, overlap)
    pieces = encode_pieces(long.dropDuplicates(["uid"]).select("uid", "piece"), path, chunk, overlap)
    joined = pieces.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_list(F.struct("no", "ids"))).getField("ids"), ",").alias("ids"))
    return whole.unionByName(long.select("doc_id", "uid").join(joined, "uid").select("doc_id", numbers("ids")))


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array([",".join(own.encode(text.as_py())) for text in rows["piece"]], pa.string())], ["doc_id", "ids"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of `encoded` (doc_id, ids): doc_id and text, the bytes of the ids put together and read as UTF-8.

    Null ids give a null text; bytes that are not UTF-8 are replaced by U+FFFD.
    """
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lambda batches: _decode_rows(batches, path), "doc_id long, text string")


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for rows in batches:
        texts = [None if ids is None else b"".join(map(own.bytes_of.__getitem__, ids)).decode("utf-8", "replace") for ids in rows["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])
