"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Each pre-token is split into the vocabulary's tokens with the greatest total log probability; of equally
likely splits the one with the fewest tokens counts. The best score of a prefix does not depend on what
follows, so the distinct pre-tokens of a batch are put into a trie and each shared prefix is scored once.
The token count of a node is known by the pre-token that ends there. A worker's trie outlives the batch, is bounded
by MOST_NODES and MOST_BYTES of pre-tokens, and starts afresh beyond that. Pre-tokens of more than LONGEST bytes are scored on
their own in a time that grows with their length, with a window of the last scores, and are not remembered, so that endless words fill nothing.

The public rank files hold no probabilities, so a token's log probability follows from its rank by the
Zipf-Mandelbrot law. All 256 bytes are tokens, so every text can be split.

Defined results: a null or empty text has no tokens; texts of any length count in full; repeated rows
each get a row; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import math
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import PreTokenizer
from plumbline.llm.common import text_of

OFFSET = 2.7
#: Costs are whole numbers, so that ties are exact: nats times SCALE.
SCALE = 10_000
MOST_NODES = 1_000_000
MOST_BYTES = 32 << 20
LONGEST = 256
#: A score packs the cost above the number of tokens, so the smaller is the better in both.
_COUNT_BITS = 16


def token_costs(path: str, offset: float = OFFSET) -> dict[bytes, int]:
    """Each token's cost, the negative log probability of its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    total = math.log(sum(1 / (rank + offset) for rank in ranks.values()))
    return {token: round(SCALE * (math.log(rank + offset) + total)) for token, rank in ranks.items()}


class Trie:
    """Pre-tokens whose prefixes carry the best forward score."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        self.packed = {token: (cost << _COUNT_BITS) + 1 for token, cost in costs.items()}
        self.longest = max(map(len, costs))
        # the vocabulary as a trie of its own, which ends the search for tokens at a place where none goes on
        self.next: list[dict[int, int]] = [{}]
        self.cost: list[int] = [-1]
        for token, cost in costs.items():
            node = 0
            for byte in token:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.cost)
                    self.next.append({})
                    self.cost.append(-1)
                node = self.next[node][byte]
            self.cost[node] = cost
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score = array("q", [0])
        self.counts: dict[str, int] = {}
        self.held = 0

    def insert(self, pre_token: str) -> None:
        raw = pre_token.encode()
        self.held += len(raw)
        child, score, packed, node, path = self.child, self.score, self.packed, 0, [0]
        for depth, byte in enumerate(raw, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                node = child[key] = len(score)
                score.append(min(path[start] + packed[raw[start:depth]] for start in range(max(0, depth - self.longest), depth) if raw[start:depth] in packed))
            path.append(score[node])
        self.counts[pre_token] = path[-1] & (1 << _COUNT_BITS) - 1

    def alone(self, raw: bytes) -> int:
        """Token count of a long pre-token, with cost and count apart as they may outgrow the packing."""
        size, none = self.longest + 1, (1 << 62, 0)
        best = [none] * size  # of the places up to one token's length ahead
        best[0] = (0, 0)
        for start in range(len(raw)):
            cost, count = best[start % size]
            best[start % size] = none
            node = 0
            for end in range(start, min(len(raw), start + self.longest)):
                node = self.next[node].get(raw[end], 0)
                if not node:
                    break
                if self.cost[node] >= 0 and (score := (cost + self.cost[node], count + 1)) < best[at := (end + 1) % size]:
                    best[at] = score
        return best[len(raw) % size][1]

    def learn(self, pre_tokens: set[str]) -> None:
        if len(self.score) > MOST_NODES or self.held > MOST_BYTES:
            self.clear()
        for pre_token in sorted(pre_tokens - self.counts.keys()):
            self.insert(pre_token)


def _is_long(pre_token: str) -> bool:
    return len(pre_token) > LONGEST or len(pre_token) * 4 > LONGEST and len(pre_token.encode()) > LONGEST


@functools.lru_cache(maxsize=2)
def _trie(path: str) -> tuple[PreTokenizer, Trie]:
    return PreTokenizer(), Trie(token_costs(path))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    splitter, trie = _trie(path)
    for rows in batches:
        split = [splitter.split(text.as_py()) for text in rows["text"]]
        sizes = list(map(len, split))
        known = set(chain.from_iterable(split))
        long = {pre_token for pre_token in known if _is_long(pre_token)}
        extra = [0] * len(split)
        if long:
            extra = [sum(trie.alone(pre_token.encode()) for pre_token in pre_tokens if pre_token in long) for pre_tokens in split]
            split = [[pre_token for pre_token in pre_tokens if pre_token not in long] for pre_tokens in split]
        trie.learn(known - long)
        counts = [sum(map(trie.counts.__getitem__, pre_tokens)) + more for pre_tokens, more in zip(split, extra)]
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])


def count_tokens(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_pre_tokens and n_tokens."""
    return documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(lambda batches: _count(batches, path), "doc_id long, n_pre_tokens long, n_tokens long")
