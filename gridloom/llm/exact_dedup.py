"""Exact deduplication by a Golomb-coded exchange of fingerprints (operator 7).

1. One scan hashes the normalised texts natively (SHA-256) and freezes ids and digests in blocks.
2. Every block sends its sorted 64-bit fingerprints, Golomb-coded, to the owners of their ranges (each once, so a
   group of copies that holds a third of all rows costs an owner one entry per block).
3. Owners answer with a bitmap: which of them other blocks sent too. Most documents are settled by that.
4. Only suspects' texts are shuffled, for verification of their bytes: grouped by the normalised text itself, with
   partial aggregation before the shuffle, so that a hot group arrives as one row per task. The verified groups go back
   to their rows by a join that deals large groups to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, MESSAGE, answered, by_block, first_row, golomb_decode, golomb_encode, message_batch, occurrences, owner_slices, owners, replies_in_order, spread_join, table, unpacked, whole_row, written

BLOCK_ROWS = 8192


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), whole(b.column(0)), pa.array([b"".join(b.column(1).to_pylist())], pa.binary())], names=["block", "ids", "digests"])
                number += 1

    rows = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"))
    return written(rows.mapInArrow(pack, f"block long, ids array<{id_type}>, digests binary"), "prints", "uncompressed")


def _prints(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.dtype(">u8")).reshape(-1, 4)[:, 0].astype(np.uint64)


def find_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) per row of ``docs``; digest is SHA-256 of the normalised text.

    Texts are equal when they are identical after each run of ASCII white space has become one space; null counts as
    empty. The row with the smallest id stays (null ids come last); of rows with the same id and text only one, so a
    repeated row counts as a copy. Texts may be of any length: whole texts are hashed and compared. An empty table gives no
    rows; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, id_col, text_col)
    n_bytes = 64 * (blocks.select(F.sum(F.size("ids").cast("long"))).first()[0] or 0)  # digest, id, and what goes with them
    n = owners(spark, n_bytes)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def send(batches):
        for batch in batches:
            for block, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(_prints(digests))
                yield message_batch(block, [(o, golomb_encode(own[a:b])) for o, a, b in owner_slices(own, n)])

    def answer(bodies):
        return [np.packbits(c > 1).tobytes() for c in occurrences([golomb_decode(b) for b in bodies])]

    replies = answered(blocks.select("block", "digests").mapInArrow(send, MESSAGE), answer)

    def settle(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for i in range(block.num_rows):
            digests = block.column("digests")[i].as_py()
            values, inverse, counts = np.unique(_prints(digests), return_inverse=True, return_counts=True)
            sent = [b - a for _, a, b in owner_slices(values, n)]
            elsewhere = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=c) for r, c in zip(replies_in_order(got), sent)])
            suspect = (elsewhere.astype(bool) | (counts > 1))[inverse]
            at = first_row(block.column("block")[i].as_py()) + np.arange(len(suspect))
            rows = [digests[j : j + 32] for j in range(0, len(digests), 32)]
            out.append(pa.table([block.column("ids")[i].values, pa.array(at, pa.int64()), pa.array(rows, pa.binary()), pa.array(suspect)], names=["id", "at", "digest", "suspect"]))
        return pa.concat_tables(out)

    rows = by_block(blocks, n).cogroup(by_block(replies, n)).applyInArrow(settle, f"id {id_type}, at long, digest binary, suspect boolean")
    rows = written(rows, "suspects")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("first")
    groups = written(rows.filter("suspect").groupBy("digest").agg(first), "groups")
    verified = _verified(docs, text_col, groups)
    found = groups.join(verified, "digest").select("digest", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_at"), "group_size")
    suspects = spread_join(rows.filter("suspect"), found, ["digest"], "at")
    alone = rows.filter("NOT suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.unionByName(suspects.select("id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "digest"))


def _verified(docs: DataFrame, text_col: str, groups: DataFrame) -> DataFrame:
    """(digest, group_size) of the suspects, after comparing their bytes; two texts with one digest are an error."""
    keys = groups.select("digest")
    if keys.count() * 64 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)))
    same = texts.join(keys, "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("n"))
    size = F.when(F.count("*") > 1, F.raise_error(F.lit("different texts have the same SHA-256"))).otherwise(F.sum("n")).cast("long")
    return same.groupBy("digest").agg(size.alias("group_size"))


def drop_copies(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows with the same id and text one
    stays. Nulls, empty and long texts, ties and empty tables are as find_copies says."""
    per_row = find_copies(docs, id_col, text_col).groupBy("id", F.xxhash64("digest").alias("print")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    odd = written(per_row.filter("NOT stays OR n > 1"), "copies")
    repeated = odd.filter("stays").limit(1).count()
    keys = odd.select(F.col("id").alias("odd_id"), F.col("print").alias("odd_print"))
    small = odd.count() * 64 <= BROADCAST_BYTES
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.xxhash64(_digest(F.col(text_col))).alias("print"))
    on = F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("print") == F.col("odd_print"))
    left = rows.join(F.broadcast(keys) if small else keys, on, "left_anti").select("row")
    if repeated:
        again = odd.filter("stays").select(F.col("id").alias("odd_id"), F.col("print").alias("odd_print"))
        left = left.unionByName(rows.join(again, on).dropDuplicates(["odd_id", "odd_print"]).select("row"))
    return unpacked(left, docs.columns)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
