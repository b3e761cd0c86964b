"""What the operators share: scratch tables in the shared folder, frozen text blocks, and coded hash exchange.

Several operators have to refer back to "the rows that a task saw before". They first freeze the rows into
*blocks*: a written table with one row per block (a bounded run of documents), so that every later pass sees
the same block whatever Spark does with splits, retries or lost executors.

The exchange of hashes works on blocks: each block sends one sorted, coded list of hashes to every owner of a
hash range, the owner answers with one reply per message, and the replies meet their block again by its number.
Owners are as many as ``spark.sql.shuffle.partitions``, or more if the blocks are so large that an owner would hold
more than OWNER_BYTES. A hash occurs once per block at most, so a hash that a third of all rows carry doesn't make one
owner hot; a block sends a message to an owner only if it has hashes of its range, so messages grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.scratch import written
from ..plans.spread import spread_join  # noqa: F401

BLOCK_BYTES = 2 << 20
OWNER_BYTES = 64 << 20  # of text, or of hashes, for each owner or task
BROADCAST_BYTES = 32 << 20
BLOCK_ROWS = 1 << 16  # of a block at most: places in it have 16 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owners(spark: SparkSession, n_bytes: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // OWNER_BYTES))


def by_block(df: DataFrame, n: int):
    """Grouped by block, over n tasks if that is more than Spark would take."""
    return (df.repartition(n, "block") if n > owners(df.sparkSession) else df).groupBy("block")


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` in one struct, so that none can clash with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def with_id(df: DataFrame, id_col: str, ddl: str) -> StructType:
    """The schema of ``id``, of the type it has in ``df``, and columns given as DDL; names inside of the type may be any."""
    return StructType([StructField("id", df.select(id_col).schema[0].dataType), *StructType.fromDDL(ddl).fields])


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def text_bytes(blocks: DataFrame) -> int:
    return blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


# ---- frozen text blocks ----------------------------------------------------------------------------------------


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Freezes (id, text) into the written table (block, ids, sizes, body): some ``block_bytes`` of UTF-8 a block
    (one document at least, BLOCK_ROWS at most), compressed. A null text counts as empty."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def pack(batches):
        part = TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=1)
        number, ids, texts, held = 0, [], [], 0

        def row(id_kind):
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([squeeze.compress(b"".join(texts))], pa.binary())],
                names=["block", "ids", "sizes", "body"],
            )

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if texts and (held + len(t) > block_bytes or len(texts) == BLOCK_ROWS):
                    yield row(id_kind)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield row(id_kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(pack, f"block long, ids array<{id_type}>, sizes array<int>, body binary"), "blocks", "uncompressed")


def unpack(sizes, body) -> list[bytes]:
    """The texts of a block."""
    whole = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(sum(sizes))))
    ends = np.cumsum(sizes).tolist()
    return [whole[e - n : e] for e, n in zip(ends, sizes)]


def first_row(block: int) -> int:
    """The number of a block's first row: 23 bits of the partition, 24 of the block in it, 16 of the row."""
    part, number = block >> 32, block & 0xFFFFFFFF
    if part >> 23 or number >> 24:
        raise OverflowError(f"block {number} of partition {part}")
    return part << 40 | number << 16


# ---- hashing ---------------------------------------------------------------------------------------------------

MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # the 64-bit finaliser of MurmurHash3
SHIFT = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> SHIFT)) * MIX_1
        h = (h ^ (h >> SHIFT)) * MIX_2
    return h ^ (h >> SHIFT)


def owner_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Cuts the range of 64-bit hashes into n equal ranges, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def owner_slices(sorted_hashes: np.ndarray, n: int):
    """(owner, start, end) of each owner's part of sorted hashes."""
    if len(sorted_hashes) == 0:
        return
    own = owner_of(sorted_hashes, n)
    cuts = np.flatnonzero(np.diff(own)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(own)]):
        yield int(own[a]), int(a), int(b)


# ---- Golomb coding ---------------------------------------------------------------------------------------------


def golomb_encode(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as gaps in Golomb code with a power of two as divisor: 12 bytes of head (count, bits),
    8 bytes of the first number, quotients in unary, remainders in binary."""
    n = len(sorted_hashes)
    if n == 0:
        return np.array([0, 0], np.uint32).tobytes()
    gaps = np.diff(sorted_hashes)
    mean = float(gaps.astype(np.float64).mean()) if n > 1 else 1.0
    k = max(0, min(62, int(np.log2(max(1.0, mean * 0.69)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n > 1 else 0, np.uint8)
    unary[ends] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([n, k, len(unary)], np.uint32).tobytes() + sorted_hashes[:1].astype(np.uint64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def golomb_decode(coded: bytes) -> np.ndarray:
    n = int(np.frombuffer(coded, np.uint32, 1)[0])
    if n == 0:
        return np.empty(0, np.uint64)
    _, k, length = map(int, np.frombuffer(coded, np.uint32, 3))
    first = np.frombuffer(coded, np.uint64, 1, 12)
    rest = np.frombuffer(coded, np.uint8, offset=20)
    n_unary = (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(rest[:n_unary], count=length))
    quotients = np.diff(np.r_[-1, ends]) - 1
    bits = np.unpackbits(rest[n_unary:], count=(n - 1) * k).reshape(n - 1, k).astype(np.uint64)
    remainders = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) | remainders
    return np.cumsum(np.r_[first, gaps], dtype=np.uint64)


# ---- the exchange ----------------------------------------------------------------------------------------------

MESSAGE = "block long, owner int, body binary"
REPLY = "block long, owner int, reply binary"


def message_batch(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array([o for o, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["block", "owner", "body"])


def answered(messages: DataFrame, answer) -> DataFrame:
    """answer(list of bodies) -> list of replies, for all messages to an owner at once."""

    def one_owner(part: pa.Table) -> pa.Table:
        replies = answer(part.column("body").to_pylist())
        return pa.table([part.column("block"), part.column("owner"), pa.array(replies, pa.binary())], names=["block", "owner", "reply"])

    return messages.groupBy("owner").applyInArrow(one_owner, REPLY)


def occurrences(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each number of each list of distinct numbers, in how many of the lists it is."""
    if not lists:
        return []
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    return np.split(counts[inverse], np.cumsum([len(x) for x in lists])[:-1])


def replies_in_order(replies: pa.Table) -> list[bytes]:
    """The replies to a block, by owner; together they are in the order of the sorted hashes that the block sent."""
    order = np.argsort(replies.column("owner").to_numpy())
    bodies = replies.column("reply").to_pylist()
    return [bodies[i] for i in order]
