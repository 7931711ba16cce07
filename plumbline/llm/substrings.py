"""Exact substring deduplication by suffix sorting, spread over a cluster.

A byte is removed when some string of LENGTH bytes over it also starts earlier, in a document with a
smaller id or earlier in the same one; strings are judged on the input and never cross documents.

Sorting every suffix of the corpus together is neither needed nor affordable, so suffixes that could be
equal over LENGTH bytes are first brought together:

1. Every window of LENGTH bytes picks an anchor, the least hash of its GRAM-byte strings. Equal windows
   pick equal anchors at the same offset. Windows next to each other mostly share one, so a document
   becomes a few anchors, each with the bytes (its context) of the windows that picked it.
2. Anchors meet by hash. Contexts that are equal as a whole by their hashes repeat as a whole; runs of them
   that repeat one passage as it last stood before make a segment, and a segment counts only if its bytes
   and those of that earlier place have one SHA-256. If any have not, all their anchors are sorted like the
   next. Anchors with different contexts go on as candidates, all others are done.
3. The candidates' windows are suffix sorted, class by class (same anchor, same offset): a mergesort whose
   comparisons find common extensions by binary search on prefix polynomial hashes, so each takes a
   logarithmic number of steps. Neighbours that the hashes call equal are compared byte by byte.
4. Removed runs return to their documents.

Hot strings: equal contexts are joined within each task before the shuffle, and a task sends at most
LOCAL_CONTEXTS contexts an anchor to where anchors meet, as more than one already proves it a candidate.
An anchor with over HOT candidates is sorted in two steps: each task sorts its share and keeps the first of
equal windows; these are cut into pieces of a few windows, dealt by the bytes that all windows of a piece
share (equal windows share them), and the pieces are sorted again. Pieces are cut down to single windows
where they are still too many, of which each task has but one of a kind.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; a null id counts as
the smallest; rows with the same id count as one document, so that among them only an earlier start
counts, and each row gets its own result (equal rows equal ones); an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, text_of, whole_groups
from plumbline.llm.polyhash import Prefixes, U, mixed

LENGTH = 100
GRAM = 20
LOCAL_CONTEXTS = 64
HOT = 2_000
#: Windows of a piece of a hot candidate, at each turn.
WIDTHS = (8, 1)
#: Window starts that are anchored at a time, and anchors that a task joins at a time.
BLOCK = 1 << 18
ANCHORS = 1 << 19
#: Bytes of candidates that are sorted at a time, but for a group that is larger on its own.
SORTED_BYTES = 1 << 20

_ROOM = BLOCK + 4 * LENGTH
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_REPEAT, _CANDIDATE, _SINGLE = 1, 2, 0
_ANCHORS = "part long, kind int, h long, context long, uid long, ver int, lo int, span int, off int, head_uid long, head_ver int, head_lo int, head_shape int"
_FLAGS = "uid long, ver int, lo int, span int, off int, kind int, h long, head_uid long, head_ver int, head_lo int, head_shape int"
_CONTEXTS = "h long, uid long, ver int, lo int, size int, off int, context binary"
_RUNS = "uid long, ver int, start int, end int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(hash, context hash of `bits` bits, first window, last window - first, anchor - first window) of each anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(raw) - length + 1, BLOCK):
        part = raw[start : start + BLOCK + length - 1]
        prefixes, others = (Prefixes(part, base, seed, _ROOM) for seed, base in enumerate(_BASES))
        grams = mixed(prefixes.all(gram))
        place = np.arange(len(grams), dtype=U)
        least = _sliding_min((grams & ~U((1 << 20) - 1)) | place, length - gram + 1)
        at = (least & U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        anchor = at[first]
        size = last - first + length
        context = mixed(others.of(first, size) + mixed((size << 8 | anchor - first).astype(U))) >> U(64 - bits)
        found.append((grams[anchor].view(np.int64), context.view(np.int64), first + start, last - first, anchor - first))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def _before(new: np.ndarray, uid: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of sorted rows, whose runs of equal contexts begin at `new`, the last one before each that starts earlier, or itself if none does."""
    at = np.arange(len(new))
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    place = new | np.concatenate([[True], (uid[1:] != uid[:-1]) | (lo[1:] != lo[:-1])])
    first = np.flatnonzero(place)[np.cumsum(place) - 1]
    return np.where(first > begin, first - 1, at)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows for the anchors of some documents: equal contexts joined, candidates told apart where that is certain."""
    h, context, uid, ver, lo, span, off = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((lo, uid, context, h))
    h, context, uid, ver, lo, span, off = (c[order] for c in (h, context, uid, ver, lo, span, off))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], context[1:] != context[:-1]])
    before = _before(new, uid, lo)
    repeats = before < np.arange(len(before))
    contexts_before = np.cumsum(new) - np.cumsum(new)[np.flatnonzero(new_h)[np.cumsum(new_h) - 1]]
    kind = np.where(repeats, _REPEAT, np.where(contexts_before >= LOCAL_CONTEXTS, _CANDIDATE, _SINGLE))
    keep = repeats | new
    spread = mixed(uid.view(U) * U(_BASES[0]) + lo.astype(U)).view(np.int64)
    ver, lo = ver.astype(np.int32), lo.astype(np.int32)
    earlier = (np.where(repeats, c[before], 0) for c in (uid, ver, lo, (span << 16 | off).astype(np.int32)))
    columns = np.where(kind == _SINGLE, h, spread), kind.astype(np.int32), h, context, uid, ver, lo, span.astype(np.int32), off.astype(np.int32), *earlier
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["part", "kind", "h", "context", "uid", "ver", "lo", "span", "off", "head_uid", "head_ver", "head_lo", "head_shape"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for rows in batches:
        for uid, ver, raw in zip(rows["uid"].to_pylist(), rows["ver"].to_pylist(), rows["raw"]):
            found = anchors(np.frombuffer(raw.as_buffer(), np.uint8), length, gram, bits)
            n = len(found[0])
            if n:
                parts.append((*found[:2], np.full(n, uid), np.full(n, ver), *found[2:]))
                held += n
            if held >= ANCHORS:
                yield _joined(parts)
                parts, held = [], 0
    if parts:
        yield _joined(parts)


def _flag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of each anchor once those with its hash are together; anchors that are done are left out."""
    names = [field.split()[0] for field in _FLAGS.split(", ")]
    heads = ["head_uid", "head_ver", "head_lo", "head_shape"]
    for table in whole_groups(batches, "h", ANCHORS):
        h, context, uid, lo, kind = (table[name].to_numpy() for name in ("h", "context", "uid", "lo", "kind"))
        order = np.lexsort((lo, uid, context, h, kind != _SINGLE))
        table = table.take(pa.array(order))
        h, context, uid, ver, lo, kind = (table[name].to_numpy() for name in ("h", "context", "uid", "ver", "lo", "kind"))
        new_h = np.concatenate([[True], (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])])
        new = new_h | np.concatenate([[True], context[1:] != context[:-1]])
        before = _before(new, uid, lo)
        group = np.cumsum(new_h) - 1
        several = np.bincount(group, new)[group] > 1
        own = np.where(before < np.arange(len(before)), _REPEAT, np.where(several, _CANDIDATE, _SINGLE))
        met = kind == _SINGLE
        shape = table["span"].to_numpy() << 16 | table["off"].to_numpy()
        for name, values in zip(heads, (uid, ver, lo, shape)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(np.where(met, values[before], table[name].to_numpy())))
        kind = np.where(met, own, kind).astype(np.int32)
        table = table.set_column(table.schema.get_field_index("kind"), "kind", pa.array(kind))
        yield from table.select(names).filter(pa.array(kind != _SINGLE)).to_batches()


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each candidate, and the SHA-256 of each segment (off -1)."""
    for rows in batches:
        out: list[tuple] = []
        for uid, ver, raw, places in zip(rows["uid"].to_pylist(), rows["ver"].to_pylist(), rows["raw"].to_pylist(), rows["places"].to_pylist()):
            for p in places:
                part = raw[p["lo"] : p["lo"] + p["size"]]
                out.append((p["h"], uid, ver, p["lo"], p["size"], p["off"], part if p["off"] >= 0 else hashlib.sha256(part).digest()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "uid", "ver", "lo", "size", "off", "context"])


class Suffixes:
    """Suffixes of a byte array, compared over their first `length` bytes."""

    def __init__(self, raw: np.ndarray, length: int, base: int = _BASES[0]) -> None:
        self.raw, self.length = raw, length
        self.prefixes = Prefixes(raw, base, 7, 1 << max(20, int(len(raw) + 1).bit_length()))

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at x and y share, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefixes.of(x, middle) == self.prefixes.of(y, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        shared = self.extension(x, y)
        equal = shared == self.length
        at = np.minimum(shared, self.length - 1)
        return np.where(equal, or_equal, self.raw[x + at] < self.raw[y + at])

    def sort(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """`starts` mergesorted within each run of equal `group`; returns places in `starts`. Stable."""
        n = len(starts)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        number = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
        ends = np.concatenate([begin[1:], [n]])
        first, end = begin[number], ends[number]
        size = 1
        while (live := np.flatnonzero(end - first > size)).size:
            rank = live - first[live]
            run = rank // size
            sibling = first[live] + (run ^ 1) * size
            low = np.minimum(sibling, end[live])
            stop = np.minimum(sibling + size, end[live])
            from_ = low.copy()
            own = starts[order[live]]
            right = run % 2 == 1
            while (open_ := np.flatnonzero(low < stop)).size:
                middle = (low[open_] + stop[open_]) // 2
                # elements of the left run go before equal ones of the right run
                before = self.less(starts[order[middle]], own[open_], right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                stop[open_] = np.where(before, stop[open_], middle)
            target = first[live] + run // 2 * 2 * size + rank % size + (low - from_)
            new = order.copy()
            new[target] = order[live]
            order, size = new, 2 * size
        return order


def repeated_windows(contexts: list[bytes], key: np.ndarray, offset: np.ndarray, uid: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context number, window) of each window that also starts earlier among the candidates."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + within
    shift, place = within - offset[owner], lo[owner] + within
    order = np.lexsort((place, uid[owner], shift, key[owner]))
    changes = (key[owner][order][1:] != key[owner][order][:-1]) | (shift[order][1:] != shift[order][:-1])
    group = np.concatenate([[0], np.cumsum(changes)])
    alone = np.bincount(group)[group] == 1
    order, group = order[~alone], group[~alone]
    if not len(order):
        return order, order
    suffixes = Suffixes(raw, length)
    ranked = suffixes.sort(starts[order], group)
    order = order[ranked]
    a, b = order[:-1], order[1:]
    equal = (group[1:] == group[:-1]) & (suffixes.prefixes.of(starts[a], length) == suffixes.prefixes.of(starts[b], length))
    for at in range(0, len(equal), 1 << 16):  # collisions are found byte by byte
        some = np.flatnonzero(equal[at : at + (1 << 16)]) + at
        reach = np.arange(length)
        if (raw[starts[a[some]][:, None] + reach] != raw[starts[b[some]][:, None] + reach]).any():
            return _by_bytes(raw, owner, within, starts, np.sort(order), key, shift, uid, place, length)
    head_flags = np.concatenate([[True], ~equal])
    head = order[np.flatnonzero(head_flags)[np.cumsum(head_flags) - 1]]
    later = (uid[owner[order]] != uid[owner[head]]) | (place[order] != place[head])
    return owner[order[later]], within[order[later]]


def _by_bytes(raw, owner, within, starts, order, key, shift, uid, place, length):
    """The same by the bytes themselves, for the case that two hashes collide."""
    first: dict[tuple, tuple] = {}
    text = raw.tobytes()
    for at in order:
        name = key[owner[at]], shift[at], text[starts[at] : starts[at] + length]
        here = uid[owner[at]], place[at]
        first[name] = min(first.get(name, here), here)
    later = np.array([at for at in order if (uid[owner[at]], place[at]) > first[key[owner[at]], shift[at], text[starts[at] : starts[at] + length]]], dtype=np.int64)
    return owner[later], within[later]


def _runs(owner: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of maximal runs of windows."""
    order = np.lexsort((within, owner))
    owner, within = owner[order], within[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (within[1:] != within[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
    return owner[first], within[first], within[last]


def _sorted_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "h", SORTED_BYTES, lambda rows: rows["context"].nbytes):
        uid, ver, lo = (table[name].to_numpy() for name in ("uid", "ver", "lo"))
        owner, within = repeated_windows(table["context"].to_pylist(), table["h"].to_numpy(), table["off"].to_numpy(), uid, lo, length)
        if len(owner):
            owner, first, last = _runs(owner, within)
            yield pa.RecordBatch.from_arrays([pa.array(uid[owner]), pa.array(ver[owner]), pa.array((lo[owner] + first).astype(np.int32)), pa.array((lo[owner] + last + length).astype(np.int32))], ["uid", "ver", "start", "end"])


def _piece_rows(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of each portion of hot candidates the runs of windows that repeat within it (context null), and pieces with the others.

    A piece has windows of one block of `width` shifts, counted from the anchor; its h is a hash of the
    anchor, the block and the bytes that all windows of the block have in common.
    """
    names = ["h", "uid", "ver", "lo", "size", "off", "context"]
    for rows in _portions(batches):
        h, uid, ver, lo, size, off = (rows[name].to_numpy() for name in names[:-1])
        contexts = rows["context"].to_pylist()
        owner, within = repeated_windows(contexts, h, off, uid, lo, length)
        out: list[tuple] = []
        for one, first, last in zip(*_runs(owner, within)) if len(owner) else ():
            out.append((0, uid[one], ver[one], lo[one] + first, last - first + length, 0, None))
        gone = set(zip(owner.tolist(), within.tolist()))
        for one, raw in enumerate(contexts):
            blocks: dict[int, list[int]] = {}
            for window in range(len(raw) - length + 1):
                if (one, window) not in gone:
                    blocks.setdefault((window - off[one]) // width, []).append(window)
            for block, windows in blocks.items():
                first, start = windows[0], off[one] + block * width
                common = raw[start + width - 1 : start + length]
                name = hashlib.blake2b(b"%d %d " % (h[one], block) + common, digest_size=8).digest()
                piece = raw[first : windows[-1] + length]
                out.append((int.from_bytes(name, "big", signed=True), uid[one], ver[one], lo[one] + first, len(piece), off[one] - first, piece))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if rows.num_rows:
            held.append(rows)
        if sum(part["context"].nbytes for part in held) >= SORTED_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the removed runs, merged, and what is left."""
    for rows in batches:
        out = []
        for uid, ver, raw, runs in zip(*(rows[name].to_pylist() for name in ("uid", "ver", "raw", "runs"))):
            merged: list[list[int]] = []
            for run in sorted((r["start"], r["end"]) for r in runs or ()):
                if merged and run[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], run[1])
                else:
                    merged.append(list(run))
            cuts = [0, *(at for run in merged for at in run), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            out.append((uid, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_NULL_ID = -(1 << 63)


def _identified(documents: DataFrame) -> DataFrame:
    """(uid, ver, raw): ver tells texts of the same id apart and is 0 where ids are unique."""
    named = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("uid"), text_of("text").alias("text"))
    texts = named.groupBy("uid", F.xxhash64("text").alias("hash")).agg(F.lit(1).alias("one"))
    shared = texts.groupBy("uid").count().filter("count > 1")
    if shared.isEmpty():
        return named.select("uid", F.lit(0).alias("ver"), F.col("text").cast("binary").alias("raw"))
    order = Window.partitionBy("uid").orderBy("hash")
    versions = texts.select("uid", "hash", F.row_number().over(order).alias("ver"))
    return named.withColumn("hash", F.xxhash64("text")).join(versions, ["uid", "hash"]).select("uid", "ver", F.col("text").cast("binary").alias("raw"))


def segments(repeats: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, ver, start, size, head_uid, head_ver, head_start): neighbouring repeats that repeat one passage, where it last stood before."""
    order = Window.partitionBy("uid", "ver").orderBy("lo")
    place = lambda at: F.struct(at.alias("at"), "head_uid", "head_ver", (F.col("head_lo") - F.col("lo")).alias("by"))
    here, due = place(F.col("lo")), F.lag(place(F.col("lo") + F.col("span") + 1)).over(order)
    numbered = repeats.withColumn("number", F.sum((~here.eqNullSafe(due)).cast("int")).over(order))
    ends = F.max(F.col("lo") + F.col("span")) + length
    return numbered.groupBy("uid", "ver", "number", "head_uid", "head_ver").agg(F.min("lo").alias("start"), (ends - F.min("lo")).cast("int").alias("size"), F.min("head_lo").alias("head_start")).drop("number").distinct()


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    places = wanted.groupBy("uid", "ver").agg(F.collect_list(F.struct("h", "lo", "size", "off")).alias("places"))
    return texts.join(places, ["uid", "ver"]).mapInArrow(_context_rows, _CONTEXTS)


def _sorted_runs(contexts: DataFrame, length: int, hot: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(uid, ver, start, end) of windows that also start earlier, by sorting; hot anchors in pieces."""
    sort = lambda rows: rows.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _sorted_rows(b, length), _RUNS)
    if not widths:
        return sort(contexts)
    many = contexts.groupBy("h").count().filter(F.col("count") > hot).select("h")
    if many.isEmpty():
        return sort(contexts)
    many = durable(many)
    split = durable(contexts.join(many, "h", "left_semi").mapInArrow(lambda b: _piece_rows(b, length, widths[0]), _CONTEXTS))
    done = split.filter("context is null").select("uid", "ver", F.col("lo").alias("start"), (F.col("lo") + F.col("size")).alias("end"))
    rest = _sorted_runs(split.filter("context is not null"), length, hot, widths[1:])
    return sort(contexts.join(many, "h", "left_anti")).unionByName(done).unionByName(rest)


def removed_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(uid, ver, start, end) of removed runs, which may overlap, for `texts` (uid, ver, raw); fewer `bits` make contexts collide."""
    rows = texts.mapInArrow(lambda b: _anchor_rows(b, length, gram, bits), _ANCHORS)
    flags = durable(rows.repartition("part").sortWithinPartitions("h").mapInArrow(_flag_rows, _FLAGS))
    repeats = flags.filter(F.col("kind") == _REPEAT)
    parts = durable(segments(repeats, length))
    sides = parts.select("uid", "ver", "start", "size").union(parts.select("head_uid", "head_ver", "head_start", "size")).distinct()
    candidate = lambda uid, ver, lo, span, off: ("h", F.col(uid).alias("uid"), F.col(ver).alias("ver"), F.col(lo).alias("lo"), (span + length).cast("int").alias("size"), off.cast("int").alias("off"))
    own, shape = ("uid", "ver", "lo", F.col("span"), F.col("off")), F.col("head_shape")
    earlier = ("head_uid", "head_ver", "head_lo", F.shiftright(shape, 16), shape.bitwiseAND(F.lit(0xFFFF)))
    wanted = flags.filter(F.col("kind") == _CANDIDATE).select(*candidate(*own))
    contexts = durable(_contexts(texts, wanted.unionByName(sides.select(F.lit(0).cast("long").alias("h"), "uid", "ver", F.col("start").alias("lo"), "size", F.lit(-1).alias("off")))))

    digests = contexts.filter("off < 0").select("uid", "ver", F.col("lo").alias("start"), "size", F.col("context").alias("digest"))
    head = ["head_uid", "head_ver", "head_start", "size"]
    seen = parts.join(digests, ["uid", "ver", "start", "size"]).groupBy(*head).agg(F.min("digest").alias("least"), F.max("digest").alias("greatest"))
    wrong = durable(seen.join(digests.toDF(*head, "digest"), head).filter("least <> digest or greatest <> digest").select(*head))
    found = _sorted_runs(contexts.filter("off >= 0"), length, hot)
    if not wrong.isEmpty():  # hashes collided: sort all contexts of these anchors
        false = parts.join(wrong, head).select("uid", "ver", "start", (F.col("start") + F.col("size")).alias("end"))
        parts = parts.join(wrong, head, "left_anti")
        keys = repeats.join(false, ["uid", "ver"]).filter("lo >= start and lo < end").select("h").distinct()
        again = flags.join(keys, "h")
        both = again.select(*candidate(*own)).union(again.filter(F.col("kind") == _REPEAT).select(*candidate(*earlier))).distinct()
        found = found.unionByName(_sorted_runs(durable(_contexts(texts, both)), length, hot))
    return parts.select("uid", "ver", "start", (F.col("start") + F.col("size")).alias("end")).unionByName(found)


def deduplicate(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (see the module's docstring)."""
    texts = _identified(documents)
    runs = removed_runs(texts, length, gram, hot, bits).groupBy("uid", "ver").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    done = texts.join(runs, ["uid", "ver"], "left").mapInArrow(_kept_rows, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.when(F.col("uid") != _NULL_ID, F.col("uid")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
