"""Benchmark decontamination by training suffix arrays (operator 1).

Every task cuts its documents into shards of some megabytes, builds the suffix array of a shard's words and binary-
searches every suffix of the benchmark in it. Where a suffix agrees on a whole window, the array gives all places. Of each
place and item the longest agreement is kept, one number, however often words repeat; one that doesn't just go on with that of the
place before is a longest verbatim match. A document lies in one shard, so no match is lost, nothing is shuffled, and memory
is that of one shard.

The benchmark goes to the tasks in broadcast blocks of bounded size, as numbers of words. Its own size is checked: beyond
MAX_BENCHMARK_BYTES of text the frozen documents are passed over once for each part of it, and the parts' results are joined.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unpacked, whole_row, with_id, written
from .suffix import larsson_sadakane, narrow

SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
MAX_BENCHMARK_BYTES = 256 << 20
#: A-Z to lower case; ASCII digits and letters and all bytes of other characters are kept, the rest parts words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def _coded(items: list[tuple[str, list[bytes]]]):
    """A block as it is broadcast: ids, words per item, each different word once, and the words as numbers of these. That is
    four bytes for a word of the text, and less than the text as a whole."""
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for _, words in items for w in words), np.int32)
    return [i for i, _ in items], np.array([len(w) for _, w in items], np.int64), b" ".join(number), flat


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (item id as string, words) of some ``block_bytes``. Rows come to the driver one partition at a time."""
    block, held = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).distinct().toLocalIterator():
        words = split_words((r[1] or "").encode())
        if not words:
            continue
        if block and held + len(r[1]) > block_bytes:
            yield block, held
            block, held = [], 0
        block.append((r[0], words))
        held += len(r[1])
    if block:
        yield block, held


class Suffixes:
    """The suffixes of the items in a block of the benchmark, as numbers of the words of a shard."""

    def __init__(self, block, number: dict, window: int):
        self.ids, sizes, words, flat = block
        known = np.fromiter((number.get(w, -1) for w in words.split()), np.int64)
        self.words = known[flat]
        ends = np.cumsum(sizes)
        self.start = ends - sizes
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.left = ends[self.item] - np.arange(len(flat))  # words from here to the item's end
        self.need = np.minimum(window, sizes)[self.item]  # an item of fewer words is one window


def _search(sequence: np.ndarray, sa: np.ndarray, q: Suffixes):
    """(item, low, high, depth, suffix), by depth: places sa[low:high] agree on ``depth`` words with a suffix of the item, a whole
    window or more. Suffixes of an item that agree with the same places to the same depth are one entry, and there is one only
    where the places become fewer, so repeated words don't multiply."""
    padded = np.concatenate([sequence, np.full(int(q.left.max(initial=0)) + 2, -2, np.int64)])
    live = np.arange(len(q.words))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    out: list[np.ndarray] = []
    depth = 0
    while len(live):
        new_low, new_high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        more = np.flatnonzero(q.left[live] > depth)
        symbol = q.words[live[more] + depth]
        more, symbol = more[symbol >= 0], symbol[symbol >= 0]
        new_low[more], new_high[more] = narrow(padded, sa, symbol, depth, low[more], high[more])
        fewer = (q.need[live] <= depth) & (new_high - new_low < high - low)
        if fewer.any():
            rows = np.c_[q.item[live[fewer]], low[fewer], high[fewer]]
            rows, first = np.unique(rows, axis=0, return_index=True)
            out.append(np.c_[rows, np.full(len(rows), depth), live[fewer][first]])
        some = new_low < new_high
        live, low, high = live[some], new_low[some], new_high[some]
        depth += 1
    return np.concatenate(out) if out else np.empty((0, 5), np.int64)


def _shard_matches(sequence, starts, sa, q: Suffixes):
    """Marks of all hit words, and matches (document, item, item's word, document's word, words): at each place the longest
    agreement with the item, unless it only goes on with that of the place before."""
    hits = _search(sequence, sa, q)
    hits = hits[np.argsort(hits[:, 0], kind="stable")]  # by item, then by depth
    change, matches = np.zeros(len(sequence) + 1, np.int64), []
    cuts = np.flatnonzero(np.r_[True, hits[1:, 0] != hits[:-1, 0]]) if len(hits) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(hits)] if len(hits) else []):
        own = hits[a:b]
        order = np.argsort(own[:, 1], kind="stable")
        ends = np.maximum.accumulate(own[order, 2])
        new = np.flatnonzero(np.r_[True, own[order[1:], 1] >= ends[:-1]])  # ranges that don't meet
        base, top = own[order[new], 1], np.maximum.reduceat(own[order, 2], new)
        offset = np.r_[0, np.cumsum(top - base)]
        longest, suffix = np.zeros(offset[-1], np.int64), np.zeros(offset[-1], np.int64)
        at = np.searchsorted(base, own[:, 1], side="right") - 1
        for low, high, depth, s in zip(*(own[:, 1:3] - (base - offset[:-1])[at][:, None]).T.tolist(), own[:, 3].tolist(), own[:, 4].tolist()):
            longest[low:high], suffix[low:high] = depth, s
        place = sa[np.concatenate([np.arange(x, y) for x, y in zip(base, top)])]
        order = np.argsort(place)
        place, longest, suffix = place[order], longest[order], suffix[order]
        np.add.at(change, place, 1)
        np.add.at(change, place + longest, -1)
        start = np.r_[True, (place[1:] != place[:-1] + 1) | (longest[1:] != longest[:-1] - 1)]
        place, longest, suffix = place[start], longest[start], suffix[start]
        doc, item = np.searchsorted(starts, place, side="right") - 1, int(own[0, 0])
        matches += zip(doc.tolist(), [item] * len(doc), (suffix - q.start[item]).tolist(), (place - starts[doc]).tolist(), longest.tolist())
    return change, matches


def _scan(window: int, blocks, longest_item: int, text_field: str | None = None):
    """The function for mapInArrow: columns (id, text) to (id, FOUND); with ``text_field`` the text is that field of id, so that
    it is sent once."""

    def shard(ids, texts):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = lambda: len(number) + 1  # 0 parts documents
        counts, parts = [], []
        for t in texts:
            words = t.translate(TO_WORDS).split()
            counts.append(len(words))
            parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        number.default_factory = None
        sequence = np.concatenate(parts)
        starts = np.cumsum([0, *[c + 1 for c in counts[:-1]]])
        bits = max(1, int(len(number)).bit_length())
        step = max(1, 63 // bits)
        wide = np.concatenate([sequence, np.zeros(step, np.int64)])
        first = np.zeros(len(sequence), np.int64)
        for k in range(step):
            first = (first << bits) | wide[k : k + len(sequence)]
        sa = larsson_sadakane(first, step, longest_item)
        total = np.zeros(len(sequence) + 1, np.int64)
        items = [set() for _ in texts]
        matches: list[list] = [[] for _ in texts]
        for b in blocks:
            q = Suffixes(b.value, number, window)
            change, found = _shard_matches(sequence, starts, sa, q)
            total += change
            for doc, item, item_word, doc_word, n in found:
                items[doc].add(q.ids[item])
                matches[doc].append({"item_id": q.ids[item], "item_word": item_word, "doc_word": doc_word, "n_words": n})
        hit = np.cumsum(np.cumsum(total)[:-1] > 0)
        ends = starts + np.array(counts, np.int64)
        n_hit = np.r_[0, hit][ends] - np.r_[0, hit][starts]
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
        return [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(matches, kind)]

    def scan(batches):
        for batch in batches:
            column = batch.column(1) if text_field is None else batch.column(0).field(text_field)
            column = column.cast(pa.string()).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            at = 0
            while at < len(sizes):  # only a shard's texts are copied out of the batch
                end, held = at, 0
                while end < len(sizes) and (end == at or held + sizes[end] <= SHARD_BYTES):
                    held += sizes[end]
                    end += 1
                ids, texts = batch.column(0).slice(at, end - at), [t or b"" for t in column.slice(at, end - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, *shard(ids, texts)], names=["id", "n_words", "n_hit", "items", "matches"])
                at = end

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=10) -> DataFrame:
    """(id, n_words, n_hit, items, matches) per row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer; a document's word inside
    any occurrence of a window is hit. items: ids (as strings, sorted) of the items with occurring windows; matches:
    longest verbatim matches as (item_id, item_word, doc_word, n_words), counted in words from 0, for each place of the document
    where one starts the longest with an item, at the first of the item's places with it. Null texts have no
    words; items without words match nothing; a null item id counts as an empty string; repeated rows give repeated
    results. Texts may be of any length; one over SHARD_BYTES is a shard of its own. Empty tables on either side give no
    matches. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _contamination(rows, benchmark, item_col, item_text_col, window)


def _contamination(rows: DataFrame, benchmark: DataFrame, item_col="item_id", item_text_col="text", window=10, text_field: str | None = None) -> DataFrame:
    """contamination of ``rows`` (id, text), or (id) where the text is the field ``text_field`` of the id."""
    spark = rows.sparkSession
    blocks, longest, total, done = [], window, 0, []
    for items, size in _benchmark_blocks(benchmark, item_col, item_text_col, BLOCK_BYTES):
        if blocks and total + size > MAX_BENCHMARK_BYTES:
            if not done:
                if text_field is not None:
                    rows, text_field = rows.withColumn("text", F.col("id").getField(text_field)), None
                rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "documents").select(F.struct("row", "id").alias("id"), "text")
            done.append(_part(rows, window, blocks, longest))
            blocks, longest, total = [], window, 0
        total += size
        longest = max(longest, *(len(w) for _, w in items))
        blocks.append(spark.sparkContext.broadcast(_coded(items)))
    if not done:
        return rows.mapInArrow(_scan(window, blocks, longest, text_field), with_id(rows, "id", FOUND))
    done.append(_part(rows, window, blocks, longest))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["doc_word"], m["doc_word"] + m["n_words"] - 1))))
    return joined.select(F.col("id.id").alias("id"), "n_words", F.size(hit).cast("long").alias("n_hit"), "items", "matches")


def _part(rows: DataFrame, window: int, blocks: list, longest: int) -> DataFrame:
    """Written results for some blocks of the benchmark, which then leave memory."""
    found = written(rows.mapInArrow(_scan(window, blocks, longest), with_id(rows, "id", FOUND)), "matches")
    for b in blocks:
        b.destroy()
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns, whatever their names. The
    rows themselves go through the scan, so that repeated or null ids need no join. Nulls, empty and long texts and empty
    tables are as contamination says. A text that is a string is sent to Python once, in its row."""
    if docs.select(text_col).schema[0].dataType.simpleString() == "string":
        found = _contamination(docs.select(whole_row(docs, "id")), benchmark, text_field=text_col, **options)
    else:
        found = contamination(docs.select(whole_row(docs), F.col(text_col).alias("text")), benchmark, id_col="row", text_col="text", **options)
    kept = found.filter("n_hit = 0")
    return unpacked(kept, docs.columns, "id")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
