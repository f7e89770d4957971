"""Token-id files: bit-plane shuffled, zstandard-compressed blocks with a chunk index.

Documents are range-partitioned and sorted by id; each partition is one shard. A task tokenizes its
documents in order, appends the end id to each, and cuts the stream of ids into fixed-size blocks. A
block is transposed into planes (bit planes, or byte planes), each plane is compressed on its own, and
Spark's Parquet writer stores the planes, so a lost executor leaves no half-written file. Beside them a
chunk index says for each block where its ids start, and a document index how many ids each has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.cached_ids import word_ids
from tidewater.llm.common import documents, in_parts, shared_dir, small_enough, whole_text
from tidewater.llm.shingles import contents

BLOCK_IDS = 65536
END_ID = 0
GROUP_BYTES = 1 << 18  # of texts encoded together
MAX_BROADCAST_SHARDS = 100_000

BLOCKS = "shard int, block int, first_id bigint, n_ids int, n_planes int, raw_bytes bigint, stored_bytes bigint, planes array<binary>, docs array<struct<doc_id:{id},start:bigint,n_tokens:bigint>>"


def transposed(octets: np.ndarray) -> np.ndarray:
    """Eight bit planes of a run of bytes, as rows: each group of eight bytes is an 8 by 8 matrix of bits,
    transposed within one 64-bit number by three rounds of swaps."""
    x = np.zeros(-(-len(octets) // 8) * 8, np.uint8)
    x[: len(octets)] = octets
    x = x.view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swap = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ swap ^ (swap << np.uint64(shift))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)


def to_planes(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """The planes of a block of ids, least significant first, each packed to bytes. Planes above the
    highest one in use are left out, so at least one remains for a block that isn't empty."""
    ids = ids.astype("<u4", copy=False)
    raw = ids.view(np.uint8).reshape(-1, 4)
    n = max(1, int(ids.max()).bit_length())
    used = [np.ascontiguousarray(raw[:, k]) for k in range(-(-n // 8))]
    if unit == "byte":
        return [x.tobytes() for x in used]
    return [plane.tobytes() for x in used for plane in transposed(x)][:n]


def from_planes(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if unit == "bit":
            part = np.unpackbits(part, count=n, bitorder="little")
        ids |= part.astype("<u4") << (8 * k if unit == "byte" else k)
    return ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", id_col: str = "doc_id", unit: str = "bit", end_id: int = END_ID, level: int = 3) -> None:
    """Write ``docs`` as token files under ``path`` (a folder that all executors reach), ordered by id;
    equal ids are ordered by their texts' hashes, null ids come first. Null texts are empty: their only id is the end id.
    No documents give no blocks. Other columns are ignored.

    Rows are dealt by (id, hash of the text, a spreading number), so even one id with a third of all rows
    takes more than one shard."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    slim = slim.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = slim.repartitionByRange(n, "doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_n").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, press = word_ids(tokenizer), zstandard.ZstdCompressor(level)
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        held, held_bytes, held_docs, block, first = [], 0, [], 0, 0
        kind = None

        def flush(size: int) -> pa.RecordBatch:
            nonlocal held, held_bytes, held_docs, block, first
            data = b"".join(held)
            ids, rest = np.frombuffer(data[: 4 * size], "<u4"), data[4 * size :]
            planes = [press.compress(p) for p in to_planes(ids, unit)]
            row = {
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first_id": pa.array([first], pa.int64()), "n_ids": pa.array([size], pa.int32()),
                "n_planes": pa.array([len(planes)], pa.int32()), "raw_bytes": pa.array([4 * size], pa.int64()), "stored_bytes": pa.array([sum(map(len, planes))], pa.int64()),
                "planes": pa.array([planes], pa.list_(pa.binary())),
                "docs": pa.array([[{"doc_id": i, "start": at, "n_tokens": k} for i, at, k in held_docs]], pa.list_(pa.struct([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64())]))),
            }
            held, held_bytes, block, first = [rest] if rest else [], len(rest), block + 1, first + size
            held_docs = [x for x in held_docs if x[1] + x[2] > first]
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for b in in_parts(batches):
            kind = b.schema.field("doc_id").type
            at = contents(b.column(1))[1]
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GROUP_BYTES, "right")) - 1)
                for i, got in zip(b.column(0).slice(lo, hi - lo).to_pylist(), words.encode(b.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    held_docs.append((i, first + held_bytes // 4, len(got) // 4 + 1))
                    held += (got, end)
                    held_bytes += len(got) + 4
                    while held_bytes >= 4 * BLOCK_IDS:
                        yield flush(BLOCK_IDS)
                lo = hi
        if held_bytes:
            yield flush(held_bytes // 4)

    dealt.mapInArrow(encode, BLOCKS.format(id=id_type)).write.option("compression", "uncompressed").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: shard, block, first_id (ids of all blocks before it, over all shards), n_ids,
    n_planes, raw and stored bytes. Running totals within a shard were stored; shards add up by a window
    over one row per shard."""
    blocks = spark.read.parquet(path).select("shard", "block", "first_id", "n_ids", "n_planes", "raw_bytes", "stored_bytes")
    return blocks.join(shard_starts(blocks), "shard").withColumn("first_id", F.col("first_id") + F.col("shard_start")).drop("shard_start")


def shard_starts(blocks: DataFrame) -> DataFrame:
    per = blocks.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
    return per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))


def read_segments(spark: SparkSession, path: str, unit: str = "bit") -> DataFrame:
    """The ids in each block by document: shard, doc_id, start (in the shard), n_tokens, at (the segment's
    own start) and ids as bytes. Blocks are decoded where they are read, without a shuffle; a document has
    more than one segment only where a block ends within it."""
    blocks = spark.read.parquet(path).select("shard", "first_id", "n_ids", "planes", "docs")
    id_type = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            kind = b.schema.field("docs").type.value_type.field("doc_id").type
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                first, n = r["first_id"], r["n_ids"]
                data = from_planes([open_(p) for p in r["planes"]], n, unit).tobytes()
                docs = r["docs"]
                cuts = [(max(d["start"], first) - first, min(d["start"] + d["n_tokens"], first + n) - first) for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * len(docs), pa.int32()), pa.array([d["doc_id"] for d in docs], kind), pa.array([d["start"] for d in docs], pa.int64()),
                        pa.array([d["n_tokens"] for d in docs], pa.int64()), pa.array([s + first for s, _ in cuts], pa.int64()), pa.array([data[4 * s : 4 * e] for s, e in cuts], pa.binary()),
                    ], names=["shard", "doc_id", "start", "n_tokens", "at", "ids"],
                )

    return blocks.mapInArrow(decode, f"shard int, doc_id {id_type}, start bigint, n_tokens bigint, at bigint, ids binary")


def read_token_files(spark: SparkSession, path: str, unit: str = "bit", ids: bool = True) -> DataFrame:
    """One row per document, read back: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with ``ids`` the ids as bytes. Without, whole documents are summed up where their block
    is read, and only pieces of documents that a block boundary cuts are shuffled."""
    parts = read_segments(spark, path, unit)
    whole = F.length("ids") == 4 * F.col("n_tokens")
    kept = F.col("ids") if ids else F.when(~whole, F.col("ids"))
    parts = parts.select("shard", "doc_id", "start", "n_tokens", F.when(whole, F.crc32("ids")).alias("crc"), F.struct("at", kept.alias("ids")).alias("part"))
    docs = parts.groupBy("shard", "start", "doc_id", "n_tokens").agg(F.max("crc").alias("crc"), F.array_sort(F.collect_list("part")).alias("parts"))
    data = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    starts = shard_starts(spark.read.parquet(path))
    docs = docs.join(F.broadcast(starts) if small_enough(starts, MAX_BROADCAST_SHARDS) else starts, "shard")
    out = ["doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", F.coalesce("crc", F.crc32(data)).alias("ids_crc32")]
    return docs.select(*out, data.alias("ids")) if ids else docs.select(*out)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, ids=False)


QUERIES = {"op5_token_files": op5_token_files}
