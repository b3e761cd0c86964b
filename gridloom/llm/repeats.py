"""Removal of repeated passages by suffix arrays (operator 10).

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else. At scale, a suffix array
over everything can't be one array, and comparing every two shards isn't linear. So:

1. Texts are frozen in blocks (shards). Each window of ``length`` bytes has an anchor, the smallest hash of its
   64-byte strings; consecutive windows with one anchor form a run. Equal windows have equal anchors, so a window
   whose anchor occurs once in the corpus needs no further look. Runs are some 170 bytes apart.
2. Anchors and the hashes of their runs' texts go to owners by range of anchors (8 + 8 bytes a run, no text). The
   owner answers which anchors recur, which whole runs recur, and which runs' windows must be compared one by one
   because runs of one anchor differ.
3. Each shard builds the suffix array of its suspicious passages by Larsson-Sadakane refinement and the common
   prefixes by Kasai's rule: windows with a neighbour of ``length`` common bytes repeat within the shard.
4. Shards are merged by binary search: the sorted, distinct windows of runs to compare go Golomb-coded to owners of
   ranges, who search each shard's list in those of the others and answer with bitmaps.

Hashes have 64 bits (runs are compared by anchor and text hash together, 128 bits). A group of copies that holds a
third of all rows costs one entry per shard and run, and is compared once: no owner gets hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, MESSAGE, answered, by_block, golomb_decode, golomb_encode, message_batch, mix, owner_slices, owners, replies_in_order, table, text_bytes, unpack, written
from .suffix import kasai, larsson_sadakane, pack_bytes

LENGTH = 400
GRAM = 64
PLACE = np.uint64((1 << 24) - 1)
SLICE = 8 << 20  # places in a slice of a longer text must fit into PLACE
ODD = np.uint64(0x9E3779B97F4A7C15)
RECURS, WHOLE, COMPARE = 1, 2, 4


def _letters() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * ODD)


KEPT_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a task's workspace: of the last size asked for


def _powers(n: int):
    """ODD ** i and its inverse, modulo 2 ** 64."""
    if n not in KEPT_POWERS:
        KEPT_POWERS.clear()
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            KEPT_POWERS[n] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (ODD, inverse))
    return KEPT_POWERS[n]


class Hashes:
    """Hashes of any parts of a text: sums of letter values times powers, scaled back to the part's start."""

    def __init__(self, text: np.ndarray):
        size = 1 << max(12, int(len(text)).bit_length())
        up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[text] * up[: len(text)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _anchor_runs(text: np.ndarray, doc_ends: np.ndarray, length: int):
    """(first window, number of windows, anchor hash, text hash) of each run in the texts of a block."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    n = len(text) - length + 1
    if n <= 0:
        return none
    hashes = Hashes(text)
    grams = np.arange(len(text) - GRAM + 1)
    gram_hash = hashes.of(grams, grams + GRAM)
    wide = length - GRAM + 1
    whole = -(-len(grams) // wide) * wide
    key = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    key[: len(grams)] = (gram_hash & ~PLACE) | grams.astype(np.uint64)
    rows = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])
    anchor = (least & PLACE).astype(np.int64)
    starts = np.arange(n)
    end_of = np.repeat(doc_ends, np.diff(np.r_[0, doc_ends]))
    good = np.flatnonzero(starts + length <= end_of[:n])
    if not len(good):
        return none
    own = anchor[good]
    new = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(good) != 1)])
    first = good[new]
    count = np.diff(np.r_[new, len(good)])
    return first, count, gram_hash[own[new]], hashes.of(first, first + count - 1 + length)


def _slices(texts: list[bytes], length: int):
    """The texts one after the other; a text over SLICE bytes alone, in overlapping slices. (offset, text, ends)."""
    offset, part, ends, held = 0, [], [], 0
    for t in texts:
        if held + len(t) > SLICE and part:
            yield offset, b"".join(part), ends
            offset, part, ends, held = offset + held, [], [], 0
        if len(t) > SLICE:
            for at in range(0, max(1, len(t) - length + 1), SLICE - length + 1):
                yield offset + at, t[at : at + SLICE], [len(t[at : at + SLICE])]
            offset += len(t)
            continue
        part.append(t)
        held += len(t)
        ends.append(held)
    if part:
        yield offset, b"".join(part), ends


def _runs(texts: list[bytes], length: int) -> np.ndarray:
    found = []
    for offset, text, ends in _slices(texts, length):
        first, count, anchor, whole = _anchor_runs(np.frombuffer(text, np.uint8), np.array(ends, np.int64), length)
        found.append(np.rec.fromarrays([first + offset, count, anchor, whole], dtype=RUN))
    return np.concatenate(found) if found else np.empty(0, RUN)


RUN = np.dtype([("first", "<u4"), ("count", "<u2"), ("anchor", "<u8"), ("whole", "<u8")])


def _blocks(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(block, ids, sizes, body, runs), written."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK_BYTES):
                    held += len(texts[end])
                    end += 1
                own = texts[at:end]
                ids = batch.column(0).slice(at, end - at)
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number], pa.int64()), ids, pa.array([[len(t) for t in own]], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(own))], pa.binary()), pa.array([_runs(own, length).tobytes()], pa.binary())],
                    names=["block", "ids", "sizes", "body", "runs"],
                )
                number, at = number + 1, end

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(pack, f"block long, ids array<{id_type}>, sizes array<int>, body binary, runs binary"), "blocks", "uncompressed")


PAIR = np.dtype([("anchor", "<u8"), ("whole", "<u8")])


def _pairs(runs: np.ndarray):
    """The distinct (anchor, whole) of a block, sorted; for each run its pair; how many runs have it."""
    order = np.lexsort((runs["whole"], runs["anchor"]))
    a, w = runs["anchor"][order], runs["whole"][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])] if len(a) else np.empty(0, bool)
    of_run = np.empty(len(a), np.int64)
    of_run[order] = np.cumsum(new) - 1
    return a[new], w[new], of_run, np.bincount(of_run) if len(a) else np.empty(0, np.int64)


def _answer_runs(bodies: list[bytes]) -> list[bytes]:
    sizes = [len(b) // 17 for b in bodies]
    part = [(np.frombuffer(b, "<u8", n), np.frombuffer(b, "<u8", n, 8 * n), np.frombuffer(b, np.uint8, n, 16 * n)) for b, n in zip(bodies, sizes)]
    anchor, whole, many = (np.concatenate(x) for x in zip(*part))
    order = np.lexsort((whole, anchor))
    a, w, times = anchor[order], whole[order], many[order].astype(np.int64) + 1
    new_a = np.r_[True, a[1:] != a[:-1]]
    new_p = new_a | np.r_[True, w[1:] != w[:-1]]
    in_a, in_p = np.cumsum(new_a) - 1, np.cumsum(new_p) - 1
    code = np.zeros(len(a), np.uint8)
    code[np.bincount(in_a, times)[in_a] > 1] |= RECURS
    code[np.bincount(in_p, times)[in_p] > 1] |= WHOLE
    several = np.bincount(in_a, new_p)[in_a] > 1  # runs of one anchor differ: one block speaks for each text
    code[new_p & several] |= COMPARE
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def _spans(starts: np.ndarray, length: int):
    """Windows' starts, sorted, as (start, end) of the bytes that they cover, joined where they touch or overlap."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length


def _windows(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first.astype(np.int64) - np.r_[0, np.cumsum(count.astype(np.int64))[:-1]], count) + np.arange(int(count.sum())) if len(first) else np.empty(0, np.int64)


def _repeats_within(text: np.ndarray, runs: np.ndarray, length: int) -> np.ndarray:
    """Windows of the runs that start twice in the shard, by its suffix array."""
    if not len(runs):
        return np.empty(0, np.int64)
    first, end = runs["first"].astype(np.int64), runs["first"].astype(np.int64) + runs["count"] - 1 + length
    cut = np.flatnonzero(first[1:] >= end[:-1])  # runs of one text overlap; the next text's don't
    start, stop = first[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]]
    size = stop - start
    places = np.repeat(start - np.r_[0, np.cumsum(size + 1)[:-1]], size + 1) + np.arange(int((size + 1).sum()))
    ends = np.cumsum(size + 1) - 1
    joined = text[np.minimum(places, len(text) - 1)]
    joined[ends] = 255  # no byte of UTF-8: parts passages
    packed = pack_bytes(joined)
    sa = larsson_sadakane(packed, 8, len(packed))
    common = kasai(packed, sa, length) >= length
    hit = common.copy()
    rank_next = np.flatnonzero(common[sa])
    hit[sa[rank_next - 1]] = True
    left = np.repeat(ends, size + 1) - np.arange(len(joined))
    return places[hit & (left >= length)]


def _bits(places: np.ndarray, n: int) -> bytes:
    marks = np.zeros(n, bool)
    marks[places] = True
    return np.packbits(marks).tobytes()


def find_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256[, kept]) per row of ``docs``; spans are (start, end) of removed runs
    of bytes, kept the bytes that remain (they may cut a character).

    Strings are judged on the input; overlaps count, also of a string with itself further on; matches never cross
    documents. Null texts count as empty; texts under ``length`` bytes lose nothing; rows that are repeated are copies
    of each other; ids aren't used, so they may be null or repeated. Texts may be of any length, longer ones go through in
    overlapping slices. Empty tables give no rows. Other columns are left out, whatever their names.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    blocks = _blocks(docs, id_col, text_col, length)
    n = owners(docs.sparkSession, text_bytes(blocks))

    def send_runs(batches):
        for batch in batches:
            for block, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                anchor, whole, _, times = _pairs(np.frombuffer(runs, RUN))
                many = (times > 1).astype(np.uint8)
                yield message_batch(block, [(o, anchor[a:b].tobytes() + whole[a:b].tobytes() + many[a:b].tobytes()) for o, a, b in owner_slices(anchor, n)])

    codes = answered(blocks.select("block", "runs").mapInArrow(send_runs, MESSAGE), _answer_runs)

    def in_shard(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for i in range(block.num_rows):
            number, sizes = block.column("block")[i].as_py(), block.column("sizes")[i].as_py()
            runs = np.frombuffer(block.column("runs")[i].as_py(), RUN)
            total, squeeze = sum(sizes), zstandard.ZstdCompressor(level=1)
            if not len(runs):
                continue
            code = np.frombuffer(b"".join(replies_in_order(got)), np.uint8)[_pairs(runs)[2]]
            text = np.frombuffer(b"".join(unpack(sizes, block.column("body")[i].as_py())), np.uint8)
            whole = runs[code & WHOLE > 0]
            flagged = np.union1d(_repeats_within(text, runs[code & RECURS > 0], length), _windows(whole["first"], whole["count"]))
            asked = runs[code & COMPARE > 0]
            asked = np.unique(_windows(asked["first"], asked["count"]))
            out.append((number, -1, squeeze.compress(_bits(flagged, total) + _bits(asked, total))))
            if len(asked):
                keys = np.unique(Hashes(text).of(asked, asked + length))
                out += [(number, o, golomb_encode(keys[a:b])) for o, a, b in owner_slices(keys, n)]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "owner", "body"])

    state = written(by_block(blocks, n).cogroup(by_block(codes, n)).applyInArrow(in_shard, MESSAGE), "state")
    merged = answered(state.filter("owner >= 0"), _merge)
    known = state.filter("owner < 0").withColumnRenamed("body", "reply").unionByName(merged)
    spans = "spans array<struct<start:int,end:int>>"

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids = []
        for i in range(block.num_rows):
            sizes = block.column("sizes")[i].as_py()
            texts = unpack(sizes, block.column("body")[i].as_py())
            ids.append(block.column("ids")[i].values)
            total, replies = sum(sizes), replies_in_order(got) if got.num_rows else []
            flags = np.zeros(total, bool)
            if replies:
                both = zstandard.ZstdDecompressor().decompress(replies[0], max_output_size=2 * (total // 8 + 1))
                half = len(both) // 2
                flags, asked = (np.unpackbits(np.frombuffer(x, np.uint8), count=total).astype(bool) for x in (both[:half], both[half:]))
                asked = np.flatnonzero(asked)
                if len(asked):
                    keys, of_window = np.unique(Hashes(np.frombuffer(b"".join(texts), np.uint8)).of(asked, asked + length), return_inverse=True)
                    sent = [b - a for _, a, b in owner_slices(keys, n)]
                    twice = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=c) for r, c in zip(replies[1:], sent)]).astype(bool)
                    flags[asked[twice[of_window]]] = True
            hits = np.flatnonzero(flags)
            at = 0
            for t in texts:
                a, b = np.searchsorted(hits, (at, at + len(t)))
                start, end = _spans(hits[a:b] - at, length)
                pieces = [t[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(t)])]
                kept = b"".join(pieces)
                row = (len(t), len(t) - len(kept), [{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())], hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
                at += len(t)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), *[pa.binary()] * with_kept]
        names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256", *["kept"] * with_kept]
        return pa.table([pa.concat_arrays(ids) if ids else pa.array([]), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=names)

    schema = f"id {id_type}, n_bytes long, n_removed long, {spans}, kept_sha256 string" + ", kept binary" * with_kept
    return by_block(blocks.drop("runs"), n).cogroup(by_block(known, n)).applyInArrow(finish, schema)


def _merge(bodies: list[bytes]) -> list[bytes]:
    """Each shard's sorted windows are searched in all shards' sorted windows of this range: two places mean a repeat."""
    lists = [golomb_decode(b) for b in bodies]
    together = np.sort(np.concatenate(lists))
    return [np.packbits(np.searchsorted(together, x, "right") - np.searchsorted(together, x, "left") > 1).tobytes() for x in lists]


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"), with_kept=False)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
