"""N-gram Jaccard join with filters under several global orders of tokens (operator 4).

A document is its set of word shingles. Sets with a Jaccard similarity of t share a token among the first
n - ceil(t n) + 1 tokens under *any* global order of tokens; a pair is verified only if that holds under three: by
document frequency and one hash, by document frequency and another hash, by a third hash alone.

1. Texts are frozen in blocks. Blocks exchange sorted, Golomb-coded shingle hashes with the owners of their ranges and
   get every shingle's class of document frequency back: exact up to 199, then in steps of a ninth.
2. Under the first order, rarest first, most prefixes hold only shingles of a single document: these documents are
   done. The others enter the index, one row per prefix shingle that recurs, once per distinct set (equal sets have
   one representative, found by partial aggregation).
3. Candidates of a bucket (documents with one prefix shingle): in a group of near copies, all pairs would be its
   square. All members first meet two pivots, the one with the smallest share of shingles of its own, which is next to
   all others, and a hashed one. Where two documents share a shingle at places i and j of their orders, and none before,
   they share no more than what follows: pairs for which that isn't enough don't meet.
4. Filters are intersected: pairs go on if their prefixes under the second and third order meet, too; only then are the
   whole sets fetched and compared.
5. In buckets that still hold documents of different components, those outside of the largest one meet the others: in
   blocks of bounded size, dealt to tasks, where maps of parity bits are compared. Two sets' maps differ in no more bits than
   the sets in elements, so no link is lost; of documents that share a passage and little else next to none pass. Only
   those become pairs, for the filters of step 4. Links within a component don't change it.
6. Components of the links are found by joins; nothing but sizes and counts reaches the driver. Joins to a group or pivot
   that many rows have deal it to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from .common import (
    BROADCAST_BYTES, MESSAGE, answered, by_block, first_row, golomb_decode, golomb_encode, message_batch, mix, owner_slices, owners, replies_in_order, spread_join, table, text_blocks,
    text_bytes, unpack, unpacked, whole_row, written,
)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEEDS = (11, 12)  # of hashes by which pivots are picked
STEP = np.uint64(0x9E3779B97F4A7C15)
MAX_WORDS_KEPT = 1 << 20
BLOCK = 2048  # members of a bucket in one task, on either side
MAX_MAP_WORDS = 1024


class WordHashes(dict):
    """Hashes of words seen in this task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], n: int, known: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of n words; of all its words if it has fewer."""
    out = []
    for t in texts:
        words = t.translate(LOWER).split()
        if not words:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(n, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - size + 1, size, np.uint64)
            for k in range(size):
                s = mix(s * STEP + h[k : len(h) - size + 1 + k])
        out.append(np.unique(s))
    return out


def _df_class(df: np.ndarray) -> np.ndarray:
    rest = 200 + np.minimum(55, np.floor(np.log2(np.maximum(df, 200) / 200) * 6))
    return np.where(df < 200, df, rest).astype(np.uint8)


def _prefix(order: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return values[order[:size]]


def _index_rows(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int):
    """Written (id, at, n, key_1, key_2, first, second, third, tokens, map): first, second and third are the recurring shingles of
    the prefixes, map is the parity map of all; documents without a recurring one have nulls there."""
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    size = text_bytes(blocks) or 1
    n_owners = owners(spark, size)
    drop = np.uint64(64 - int(max(32, min(64, np.ceil(np.log2(size)) + 10))))  # so few collide that the order hardly suffers

    def sets_of(sizes, body, known):
        return shingle_sets(unpack(sizes, body), n_words, known)

    def tokens_of(sets):
        return np.unique(np.concatenate([s >> drop for s in sets]) if sets else np.empty(0, np.uint64), return_counts=True)

    def slices(tokens):
        return owner_slices(tokens << drop, n_owners)

    def send(batches):
        known = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, times = tokens_of(sets_of(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), known))
                times = np.minimum(times, 255).astype(np.uint8)
                parts = []
                for o, a, b in slices(tokens):
                    coded = golomb_encode(tokens[a:b])
                    parts.append((o, np.uint32(len(coded)).tobytes() + coded + times[a:b].tobytes()))
                yield message_batch(batch.column(0)[i].as_py(), parts)

    def answer(bodies):
        sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for b in bodies]
        lists = [golomb_decode(b[4 : 4 + n]) for b, n in zip(bodies, sizes)]
        times = np.concatenate([np.frombuffer(b, np.uint8, offset=4 + n) for b, n in zip(bodies, sizes)])
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        classes = _df_class(np.bincount(inverse, times))[inverse]
        return [x.tobytes() for x in np.split(classes, np.cumsum([len(x) for x in lists])[:-1])]

    classes = answered(blocks.select("block", "sizes", "body").mapInArrow(send, MESSAGE), answer)
    arrays = "first array<bigint>, second array<bigint>, third array<bigint>, tokens array<bigint>, map binary"

    def rows(block: pa.Table, got: pa.Table) -> pa.Table:
        known, ids, out = WordHashes(), [], []
        for i in range(block.num_rows):
            sets = sets_of(block.column("sizes")[i].as_py(), block.column("body")[i].as_py(), known)
            tokens, _ = tokens_of(sets)
            code = np.frombuffer(b"".join(replies_in_order(got)), np.uint8) if got.num_rows else np.empty(0, np.uint8)
            ids.append(block.column("ids")[i].values)
            at = first_row(block.column("block")[i].as_py())
            for k, s in enumerate(sets):
                n = len(s)
                keys = [int(np.bitwise_xor.reduce(mix(s + np.uint64(x)))) if n else 0 for x in (1, 2)]
                first = second = third = full = bits = None
                if n:
                    df = code[np.searchsorted(tokens, s >> drop)]
                    p = n - (percent * n + 99) // 100 + 1
                    order = np.lexsort((s, df))[:p]
                    index = s[order][df[order] > 1]
                    if len(index):
                        first, full, bits = index, s, parity_map(s, map_words(n))
                        order = np.lexsort((mix(s), df))[:p]
                        second = s[order][df[order] > 1]
                        order = np.argsort(mix(s + STEP))[:p]
                        third = s[order][df[order] > 1]
                signed = [None if x is None else x.view(np.int64) for x in (first, second, third, full)]
                out.append((at + k, n, *(int(np.uint64(x).view(np.int64)) for x in keys), *signed, bits))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        names = ["id", "at", "n", "key_1", "key_2", "first", "second", "third", "tokens", "map"]
        return pa.table([pa.concat_arrays(ids) if ids else pa.nulls(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=names)

    both = by_block(blocks, n_owners).cogroup(by_block(classes, n_owners))
    return written(both.applyInArrow(rows, f"id {id_type}, at long, n long, key_1 long, key_2 long, {arrays}"), "sets")


def _may_link(percent: int):
    """By sizes, and by what can be shared from places at_a and at_b on."""
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (room * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)


def _with_sides(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pairs`` (a, b) with columns of both documents."""
    side = lambda x: sets.select(F.col("at").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    halves = [spread_join(pairs, side(x), [x], other) for x, other in (("a", "b"), ("b", "a"))]
    return halves[0].join(halves[1], ["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written (a, b) of the pairs that are similar. Whole sets are fetched only for pairs that no prefix rules out."""
    pairs = written(pairs, "pairs")
    meet = F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    pairs = written(_with_sides(pairs, sets, ("second", "third")).filter(meet).select("a", "b"), "candidates")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    alike = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent
    return written(_with_sides(pairs, sets, ("n", "tokens")).filter(alike).select("a", "b"), "links")


def _pivot_pairs(index: DataFrame, percent: int, seeds: tuple[int, int]) -> DataFrame:
    """Every member of a bucket with the bucket's pivots."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), F.col("rep")).alias("h")
    own = (F.col("own") / F.col("n")).alias("share")
    pivots = index.groupBy("token").agg(
        F.count("*").alias("members"),
        F.min(F.struct(own, hashed(seeds[0]), "rep", "n", "at")).alias("p"),
        F.min(F.struct(hashed(seeds[1]), "rep", "n", "at")).alias("q"),
    ).filter("members > 1")
    pick = lambda c: F.struct(F.col(f"{c}.rep").alias("other"), F.col(f"{c}.n").alias("n_b"), F.col(f"{c}.at").alias("at_b"))
    pivots = pivots.select("token", F.array_distinct(F.array(pick("p"), pick("q"))).alias("x"))
    met = spread_join(index.withColumnsRenamed({"n": "n_a", "at": "at_a"}), pivots, ["token"], "rep")
    met = met.select("rep", "n_a", "at_a", F.explode("x").alias("x")).select("rep", "n_a", "at_a", "x.*").filter((F.col("rep") != F.col("other")) & _may_link(percent))
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _open(index: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Written rows of the buckets that hold several components, with their component, the bucket's largest one, and how many
    rows are outside of that."""
    known = index.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = written(known, "buckets")
    groups = known.groupBy("token", "component").count()
    major = F.max(F.struct("count", "component")).alias("major")
    mixed = groups.groupBy("token").agg(major, F.sum("count").alias("members")).select("token", F.col("major.component").alias("major"), (F.col("members") - F.col("major.count")).alias("outside")).filter("outside > 0")
    return written(spread_join(known, mixed, ["token"], "rep"), name)


def parity_map(hashes: np.ndarray, n_words: int) -> bytes:
    """64 * n_words bits; each is the parity of how many hashes fall on it, so that two sets' maps differ in no more bits than the
    sets have elements that are in one of them only."""
    bits = np.bincount((mix(hashes ^ STEP) % np.uint64(64 * n_words)).astype(np.int64), minlength=64 * n_words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def map_words(n: int) -> int:
    """Words of a set's map: a bit or more for each element, up to MAX_MAP_WORDS; powers of two, so that longer maps fold."""
    return 1 << max(2, min(MAX_MAP_WORDS.bit_length() - 1, int(n - 1 >> 6).bit_length()))


def _fold(maps: np.ndarray, n_words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, n_words), axis=1)


def _rest_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of open buckets: members outside of the largest component with members of other components, as far as parity maps,
    sizes and places don't rule the pair out. Maps are compared in blocks of BLOCK members; only what passes becomes a row.
    Buckets with the same members are one."""
    shape = F.struct(F.count("*"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(20,0)")))
    buckets = rows.groupBy("token").agg(shape.alias("shape"), F.count("*").alias("members"), F.first("outside").alias("outside"))
    same = F.min(F.struct("token", "members", "outside")).alias("x")
    once = buckets.groupBy("shape").agg(same).select("x.token", F.ceil(F.col("x.members") / BLOCK).cast("int").alias("right"), F.ceil(F.col("x.outside") / BLOCK).cast("int").alias("left"))
    known = rows.drop("outside").join(sets.select(F.col("at").alias("rep"), "map"), "rep")
    known = written(spread_join(written(known, "members"), once, ["token"], "rep"), "maps")
    slot = lambda n: F.pmod(F.xxhash64(F.lit(3), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["token", "rep", "n", "at", "component", "map"]
    right = known.withColumn("j", slot("right")).withColumn("i", every("left"))
    left = known.filter("component <> major").withColumn("i", slot("left")).withColumn("j", every("right"))
    met = right.select(*columns, "i", "j", F.lit(False).alias("asks"), (F.col("component") == F.col("major")).alias("main"))
    met = met.unionByName(left.select(*columns, "i", "j", F.lit(True).alias("asks"), F.lit(False).alias("main")))

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        rep, n, at, component = (group.column(c).to_numpy() for c in ("rep", "n", "at", "component"))
        main = group.column("main").to_numpy(zero_copy_only=False)
        maps = group.column("map").to_pylist()
        width = np.array([len(x) >> 3 for x in maps])
        out_a, out_b = [], []
        for w in np.unique(width[~asks]):
            r = np.flatnonzero(~asks & (width == w))
            others = np.frombuffer(b"".join(maps[k] for k in r), np.uint64).reshape(len(r), w)
            for v in np.unique(width[asks]):
                least = min(v, w)
                folded = others if w == least else _fold(others, least)
                for k in np.flatnonzero(asks & (width == v)):
                    own = np.frombuffer(maps[k], np.uint64)[None, :]
                    own = own if v == least else _fold(own, least)
                    both, room = n[r] + n[k], np.minimum(n[r] - at[r], n[k] - at[k])
                    may = (component[r] != component[k]) & (main[r] | (rep[r] > rep[k]))
                    may &= (np.minimum(n[r], n[k]) * 100 >= np.maximum(n[r], n[k]) * percent) & (room * (100 + percent) >= both * percent)
                    c = np.flatnonzero(may)
                    differ = np.bitwise_count(folded[c] ^ own).sum(axis=1, dtype=np.int64)
                    c = c[differ * (100 + percent) <= both[c] * (100 - percent)]
                    out_a.append(np.minimum(rep[r[c]], rep[k]))
                    out_b.append(np.maximum(rep[r[c]], rep[k]))
        cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table([cat(out_a), cat(out_b)], names=["a", "b"])

    return met.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_components(docs: DataFrame, id_col="doc_id", text_col="text", n_words: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, at) per row of ``docs``: documents link when their shingle sets' Jaccard
    similarity is ``percent`` / 100 at least; component_id is the smallest id reachable by links, its own included.

    A document of fewer words has one shingle, all its words; one without words, or null, has none, links with nothing
    and is its own component. Repeated rows link with each other. Rows are told apart by ``at``, so ids may be null or
    repeated; a component of null ids only has a null component_id. Texts may be of any length, all their words count. Empty
    tables give no rows. Other columns are left out, whatever their names.
    """
    rows = _index_rows(docs, id_col, text_col, n_words, percent)
    sets = rows.filter("first IS NOT NULL")
    keys = ["key_1", "key_2", "n"]
    reps = written(sets.groupBy(*keys).agg(F.min("at").alias("rep"), F.min("id").alias("least")), "reps")
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    index = sets.join(reps.select(F.col("rep").alias("at")), "at", "left_semi")
    index = index.select(F.posexplode("first").alias("k", "token"), F.col("at").alias("rep"), "n", (prefix - F.size("first")).alias("own"))
    index = written(index.select("token", "rep", "n", "own", (F.col("own") + F.col("k")).alias("at")), "index")
    links = _verify(_pivot_pairs(index, percent, SEEDS), sets, percent)
    labels = connected_components(links, "a", "b", spread=True)
    more = _verify(_rest_pairs(_open(index, labels, "open"), sets, percent), sets, percent)
    if more.limit(1).count():
        labels = connected_components(links.union(more), "a", "b", spread=True)
    named = reps.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named, "named")
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = spread_join(named, groups, ["component"], "rep").select(*keys, "component_id")
    members = written(sets.select("id", "at", *keys), "members")
    linked = spread_join(members, named, keys, "at").select("id", F.col("n").alias("n_shingles"), "component_id", "at")
    alone = rows.filter("first IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), "at")
    return alone.unionByName(linked)


def drop_near_copies(docs: DataFrame, id_col="doc_id", text_col="text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays per component, the one with the smallest id (null ids
    come last), with all their columns, whatever their names. Rows are told apart by id and text; of repeated rows one stays.
    Null and empty texts, texts without words, long ones and empty tables are as near_components says: what links with nothing
    stays."""
    packed = docs.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("print")).alias("key"), F.col(text_col).alias("text"))
    found = near_components(packed, "key", "text", n_words, percent)
    best = written(found, "components").withColumn("same", F.col("id") == F.col("component_id"))
    gone = best.filter("NOT same").select("id").distinct()
    small = gone.count() * 64 <= BROADCAST_BYTES
    gone = gone.select(F.col("id.own_id").alias("gone_id"), F.col("id.print").alias("gone_print"))
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"))
    on = lambda x: F.col("id").eqNullSafe(F.col(f"{x}_id")) & (F.col("print") == F.col(f"{x}_print"))
    left = rows.join(F.broadcast(gone) if small else gone, on("gone"), "left_anti")
    again = best.filter("same").groupBy("id").count().filter("count > 1").select(F.col("id.own_id").alias("again_id"), F.col("id.print").alias("again_print"))
    again = written(again, "again")
    if not again.limit(1).count():
        return unpacked(left, docs.columns)
    ones = left.join(again, on("again")).dropDuplicates(["again_id", "again_print"]).select("row")
    return unpacked(left.join(again, on("again"), "left_anti").select("row").unionByName(ones), docs.columns)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
