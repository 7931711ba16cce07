"""Alignment of two tokenizers over the same bytes, by pointer jumping.

A byte-level BPE (A) encodes a space and the text, a piece BPE with byte fallback (B) the text, to which it
adds that space. Tokens of both cover the same bytes; two tokens are linked where their bytes overlap, and
the linked ones form groups, which end where both have an end. Every token points to its farthest-right
overlapping token (of tokens with the same end to that of A). Doubling these pointers, all at once, reaches
the last token of each group in a logarithm of its length; that token labels the group.

Neither tokenizer merges across a single space between two words, so texts are cut there, each distinct
unit is encoded once and remembered up to a bound, and long texts go through in portions of SLICE bytes.
Where B's vocabulary has a piece that does span a space, texts are encoded whole.

An id pair's count over the corpus: the distinct pairs of each document are written once with the table of
results, summed up by Spark before the shuffle, and compared with the highest count of their B id. The HOT
most frequent pairs (a bound of 24 bytes a pair) are handed to all tasks and looked up there; the pairs
beyond go through a join, so that nothing is left out and what is broadcast doesn't grow.

Defined results: a null or empty text, or one whose joined token bytes differ from the space and the text,
has zeros and an empty groups_sha256, and takes no part in the counts; repeated rows and ids count each;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_of

#: Pairs that are handed to all tasks.
HOT = 1 << 20
#: Bytes of text whose tokens are linked at a time.
SLICE = 1 << 20
#: Distinct units that a worker remembers before it starts afresh; longer ones are not remembered.
REMEMBERED = 1 << 19
LONG_UNIT = 256
#: A pair is A's id times STRIDE plus B's id.
STRIDE = 1 << 20

# White space, controls, format characters and B's own sign for a space, beside which no cut is made.
BLANK = "\\x00-\\x20\\x7f-\\xa0\\xad\u1680\u180e\u2000-\u206f\u2581\u3000\ufeff"
#: A single space between two other characters.
CUT = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
BLANK_BEFORE, BLANK_BEHIND = re.compile(f"[{BLANK}] "), re.compile(f" [{BLANK}]")
WHOLE = re.compile(f"(?s)[^{BLANK}](?:.*[^{BLANK}])?")


def _byte_of_letter() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Tokenizer A: ids and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_of_letter()
        raw = {i: bytes(letters[c] for c in entry) for entry, i in model["vocab"].items() if all(c in letters for c in entry)}
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError("the vocabulary's ids do not follow the order of its merges")
        self.bytes_of = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={}).encode_ordinary


class PieceBpe:
    """Tokenizer B: ids and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)]
        self.spans_spaces = any("▁" in piece.lstrip("▁") for piece in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Flat:
    """Growing arrays of numbers, one after the other, with a start and a count for each list."""

    def __init__(self) -> None:
        self.values, self.starts, self.counts, self.used, self.lists = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def extend(self, values: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.lists + len(counts) > len(self.counts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.values[self.used : self.used + len(values)] = values
        own = slice(self.lists, self.lists + len(counts))
        self.starts[own], self.counts[own] = np.cumsum(counts) - counts + self.used, counts
        self.used, self.lists = self.used + len(values), self.lists + len(counts)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of some lists, the count of each)."""
        counts = self.counts[which]
        return self.values[spread(self.starts[which], counts)], counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the count of each list."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


class _Numbers(dict):
    """Numbers units in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Units:
    """Encodes lists of units, each distinct one once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteBpe(path_a), PieceBpe(path_b)
        self.cut = None if self.b.spans_spaces else CUT
        self.length_a, self.length_b = (np.array(list(map(len, own.bytes_of)), np.int64) for own in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.number, self.ids_a, self.ids_b, self.bad = _Numbers(), _Flat(), _Flat(), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The units of a text that isn't empty."""
        if not self.cut:
            return [text]
        if text[0] == " " or text[-1] == " " or BLANK_BEFORE.search(text) or BLANK_BEHIND.search(text):
            return self.cut.split(text)
        return text.split(" ")

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts; units that begin and end with no blank are encoded in one go."""
        if not (self.cut and all(map(WHOLE.fullmatch, units))):
            return flattened([self.a.encode(" " + unit) for unit in units])
        ids = np.array(self.a.encode(" " + " ".join(units)), np.int32)
        until = np.searchsorted(np.cumsum(self.length_a[ids]), np.cumsum([len(unit.encode()) + 1 for unit in units]), "right")
        return ids, np.diff(until, prepend=0)

    def _learn(self, new: list[str], at: int) -> None:
        raw = [b" " + unit.encode() for unit in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        wrong = np.zeros(len(new), bool)
        for flat, own, lengths, (ids, counts) in ((self.ids_a, self.a, self.length_a, self._encode_a(new)), (self.ids_b, self.b, self.length_b, flattened(self.b.encode(new)))):
            flat.extend(ids, counts)
            until = np.cumsum(counts)
            wrong |= np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], until])]) != sizes
            parts = list(map(own.bytes_of.__getitem__, ids.tolist()))
            if b"".join(parts) != b"".join(raw):
                wrong |= [b"".join(parts[stop - n : stop]) != text for stop, n, text in zip(until, counts, raw)]
        self.bad = np.concatenate([self.bad, at + np.flatnonzero(wrong)])

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """(ids of A, tokens of each unit in A, ids of B, tokens of each unit in B, whether both give back the bytes of all units)."""
        if len(self.number) >= REMEMBERED:
            self.forget()
        at = len(self.number)
        which = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))
        if new := self.number.taken():
            self._learn(new, at)
        found = *self.ids_a.of(which), *self.ids_b.of(which), not np.isin(which, self.bad).any()
        if max(map(len, new), default=0) > LONG_UNIT:
            self.forget()
        return found


def labelled(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terminal token of each token of A, that of each token of B, links as two rows of token numbers of A and of B).

    Tokens of A are numbered from 0, those of B behind them. Both must cover the same bytes.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    at_a = np.repeat(np.arange(n_a, dtype=np.int32), np.diff(ends_a, prepend=0))
    at_b = np.repeat(np.arange(n_a, n_a + n_b, dtype=np.int32), np.diff(ends_b, prepend=0))
    over_a, over_b = at_b[ends_a - 1], at_a[ends_b - 1]
    # B's token over A's last byte reaches at least as far; where it ends there too, A's own token is the last
    points = np.concatenate([np.where(ends_b[over_a - n_a] > ends_a, over_a, np.arange(n_a, dtype=np.int32)), over_b])
    while True:
        farther = points[points]
        if np.array_equal(farther, points):
            break
        points = farther
    last = np.zeros(len(at_a), bool)
    last[ends_a - 1] = last[ends_b - 1] = True
    ends = np.flatnonzero(last)
    return points[:n_a], points[n_a:], np.stack([at_a[ends], at_b[ends] - n_a])


class Aligned:
    """What is known of one document, portion by portion."""

    def __init__(self) -> None:
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links = True, 0, 0, 0, 0
        self.digest, self.pairs = hashlib.sha256(), []

    def add(self, text: bytes, n_a: int, n_b: int, pairs: np.ndarray) -> None:
        self.digest.update(text if not self.n_groups else b";" + text)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + text.count(b"|"), self.n_links + len(pairs)
        self.pairs.append(pairs)
        if len(self.pairs) > 64:
            self.pairs = [np.concatenate(self.pairs)]

    def row(self) -> tuple:
        """Counts, digest, distinct pairs and how many links have each."""
        if not self.good or not self.n_groups:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), *np.unique(np.concatenate(self.pairs), return_counts=True)


class Aligner:
    """Aligns texts, many at a time."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.units = Units(path_a, path_b)
        names = [[b"%d" % i for i in range(len(own.bytes_of))] for own in (self.units.a, self.units.b)]
        self.size_a, self.size_b = map(len, names)
        self.written = [name + sign for own, signs in zip(names, ((b",", b"|"), (b",", b";"))) for sign in signs for name in own]

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray) -> np.ndarray:
        """Tokens in the order in which groups are written, as numbers of `written`."""
        last_a = label_a == np.arange(len(ids_a))
        rank = np.cumsum(last_a) - 1
        group_a, group_b = rank[label_a], rank[label_b]
        size_b = np.bincount(group_b, minlength=int(rank[-1]) + 1)
        until = np.cumsum(size_b)
        last_b = np.zeros(len(ids_b), bool)
        last_b[until - 1] = True
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + (until - size_b)[group_a]] = ids_a + self.size_a * last_a
        order[np.arange(len(ids_b)) + np.cumsum(np.bincount(group_a))[group_b]] = 2 * self.size_a + ids_b + self.size_b * last_b
        return order

    def align(self, texts: list[str]) -> list[Aligned]:
        found = [Aligned() for _ in texts]
        owners, units, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            own = self.units.split(text)
            for at in range(0, len(own), SLICE // 8):
                part = own[at : at + SLICE // 8]
                owners.append((found[i], len(part)))
                units += part
                size += sum(map(len, part)) if len(own) > len(part) else len(text)
                if size >= SLICE:
                    self._portion(owners, units)
                    owners, units, size = [], [], 0
        if units:
            self._portion(owners, units)
        return found

    def _portion(self, owners: list[tuple[Aligned, int]], units: list[str]) -> None:
        ids_a, per_a, ids_b, per_b, good = self.units.tokens(units)
        if not good:  # texts that hold an inexact unit have no tokens; the others go on without them
            kept, at = [], 0
            for owner, n in owners:
                own = units[at : at + n]
                at += n
                if not owner.good or not self.units.tokens(own)[4]:
                    owner.good = False
                else:
                    kept.append((owner, own))
            if kept:
                self._portion([(owner, len(own)) for owner, own in kept], [unit for _, own in kept for unit in own])
            return
        ends_a, ends_b = np.cumsum(self.units.length_a[ids_a]), np.cumsum(self.units.length_b[ids_b])
        label_a, label_b, (link_a, link_b) = labelled(ends_a, ends_b)
        order = self._written(ids_a, ids_b, label_a, label_b)
        pairs = ids_a[link_a].astype(np.int64) * STRIDE + ids_b[link_b]
        starts = np.cumsum([0, *(n for _, n in owners)])[:-1]
        sizes_a, sizes_b = np.add.reduceat(per_a, starts), np.add.reduceat(per_b, starts)
        links = np.searchsorted(link_a, np.cumsum(sizes_a))
        tokens, written = np.cumsum(sizes_a + sizes_b), self.written.__getitem__
        for k, (owner, _) in enumerate(owners):
            own = order[tokens[k] - sizes_a[k] - sizes_b[k] : tokens[k]]
            owner.add(b"".join(map(written, own.tolist()))[:-1], int(sizes_a[k]), int(sizes_b[k]), pairs[links[k - 1] if k else 0 : links[k]])


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct `pairs` with their `times`."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        names, lists = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"], pa.list_(pa.int64())
        for rows in batches:
            found = [aligned.row() for aligned in own.align(rows["text"].to_pylist())]
            columns = list(zip(*found)) if found else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()]
            offsets = pa.array(np.cumsum([0, *map(len, columns[5])]), pa.int32())
            held = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)), type=lists) for x in columns[5:]]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], *map(pa.array, columns[:5], kinds), *held], ["doc_id", *names, "pairs", "times"])

    texts = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return texts.mapInArrow(rows_of, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the whole corpus have each id pair, and whether no other pair of its B id has more."""
    linked = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("count"))
    counts = durable(linked.withColumnRenamed("pairs", "pair"))
    highest = counts.groupBy((F.col("pair") % STRIDE).alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, F.col("pair") % STRIDE == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _looked_up(batches: Iterator[pa.RecordBatch], known: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs of each document that are known, and the other pairs."""
    for rows in batches:
        pairs, times = (rows[name].values.to_numpy() for name in ("pairs", "times"))
        sizes = np.diff(rows["pairs"].offsets.to_numpy())
        first = rows["pairs"].offsets[0].as_py()
        pairs, times = pairs[first : first + sizes.sum()], times[first : first + sizes.sum()]
        at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        until = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[until])
        n_best, count_sum = (total(np.where(hit, times * own[at], 0) if len(known) else times * 0) for own in (best, counts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(~hit)])[until], pa.int32())
        rest = [pa.ListArray.from_arrays(offsets, pa.array(values[~hit])) for values in (pairs, times)]
        yield pa.RecordBatch.from_arrays([rows["uid"], pa.array(n_best), pa.array(count_sum), *rest], ["uid", "n_best", "count_sum", "pairs", "times"])


def scores(documents: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair has its B id's highest count in the corpus, count_sum adds the counts up over all links.
    """
    aligned = durable(align(documents, path_a, path_b).withColumn("uid", F.monotonically_increasing_id()))
    counts = durable(pair_counts(aligned))
    top = counts.orderBy(F.desc("count"), "pair").limit(hot).toArrow().sort_by("pair")  # at most `hot` rows
    shared = documents.sparkSession.sparkContext.broadcast(tuple(top[name].to_numpy() for name in ("pair", "count", "best")))
    found = durable(aligned.select("uid", "pairs", "times").mapInArrow(lambda batches: _looked_up(batches, *shared.value), "uid long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = found.select("uid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(counts, "pair")
    rest = rest.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    both = aligned.drop("pairs", "times").join(found.select("uid", "n_best", "count_sum"), "uid").join(rest, "uid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
