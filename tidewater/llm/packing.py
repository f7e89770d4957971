"""Best-fit packing of token sequences with a bounded number of open bins.

Each task packs the documents of its split of the input as they come, without a shuffle: a piece goes to the
open bin whose free space is the least that holds it. The free spaces of open bins are the set bits of one
number, so that bin is the lowest bit at or above the piece's length. If no open bin holds the piece a new
one is opened, and where that makes more than a fixed number, the fullest closes first.

At its end a task has some open bins; those at most half full are packed again, as wholes, across tasks,
so that many small splits don't leave many sequences half empty. Pieces stay together and in their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.cached_ids import FoldedIds, kept
from tidewater.llm.common import documents, in_parts, small_enough, stored, whole_text
from tidewater.llm.shingles import contents

SIZE = 4096
END_ID = 1
OPEN_BINS = 256
GROUP_BYTES = 1 << 18  # of texts encoded together
BINS_PER_TASK = 100_000  # half-full bins packed again in one task
MAX_BROADCAST_MOVES = 1_000_000


class OpenBins:
    """Online best fit of pieces into bins of ``size``, of which at most ``most`` are open."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.opened = 0

    def _take(self, free: int) -> int:
        """Remove an open bin with so much free."""
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``size``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self.open == self.most:  # only after a new bin was opened
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest >= left:  # the new one is the fullest
                    return number, self.size - free
                self._take(fullest)
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - free

    def rest(self) -> list[tuple[int, int]]:
        """(bin, used) of the open bins."""
        return [(b, self.size - free) for free, bins in sorted(self.by_free.items()) for b in bins]


PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, open_used bigint, ids binary"


def numbered(task: int, bins: list[int]) -> pa.Array:
    return pa.array(np.array(bins, np.int64) + (task << 40), pa.int64())


def packed_by_task(docs: DataFrame, tokenizer: str, size: int, most: int, end_id: int, ids: bool) -> DataFrame:
    """The pieces of (doc_id, text) with their bins, and a row for each bin at most half full that is open at
    a task's end: its number and ``open_used``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, bins, task, end = kept(FoldedIds, tokenizer), OpenBins(size, most), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        kind, width = None, 4 * size
        for b in in_parts(batches):
            kind, at, lo = b.schema.field("doc_id").type, contents(b.column(1))[1], 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GROUP_BYTES, "right")) - 1)
                owner, pieces, data, places = [], [], [], []
                for row, got in enumerate(words.encode(b.column(1).slice(lo, hi - lo).to_pylist()), lo):
                    got += end
                    for k in range(0, len(got), width):
                        cut = got[k : k + width]
                        owner.append(row)
                        pieces.append(k // width)
                        data.append(cut)
                        places.append(bins.place(len(cut) // 4))
                n = len(owner)
                piece = np.array(pieces, np.int64)
                columns = [
                    b.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(list(map(zlib.crc32, data)), pa.int64()),
                    numbered(task, [x for x, _ in places]), pa.array([x for _, x in places], pa.int64()), pa.nulls(n, pa.int64()), pa.array(data, pa.binary()) if ids else pa.nulls(n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi
        rest = [(b, used) for b, used in bins.rest() if 2 * used <= size]
        if rest:
            n = len(rest)
            empty = [pa.nulls(n, t) for t in (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, numbered(task, [b for b, _ in rest]), pa.nulls(n, pa.int64()), pa.array([u for _, u in rest], pa.int64()), pa.nulls(n, pa.binary())], names=names)

    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(run, schema)


def packed_again(open_bins: DataFrame, size: int, most: int) -> DataFrame:
    """(bin, to, base) for the bins of (bin, open_used) that move into another one: its number and where they start
    in it. The biggest come first; a task gets ``BINS_PER_TASK`` bins or about that."""
    n = -(-open_bins.count() // BINS_PER_TASK)
    dealt = open_bins.repartition(max(1, n), F.xxhash64("bin")).sortWithinPartitions(F.desc("open_used"), "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(size, most), {}
        for b in batches:
            number, used = b.column(0).to_pylist(), b.column(1).to_pylist()
            places = [bins.place(u) for u in used]
            for own, (to, base) in zip(number, places, strict=True):
                if base == 0:
                    first[to] = own
            moved = [(own, first[to], base) for own, (to, base) in zip(number, places, strict=True) if base]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*moved, strict=True)] if moved else [pa.array([], pa.int64())] * 3, names=["bin", "to", "base"])

    return dealt.mapInArrow(run, "bin bigint, to bigint, base bigint")


def packed(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", size: int = SIZE, open_bins: int = OPEN_BINS, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32,
    sequence_id, offset (its place in the sequence) and, with ``ids``, its ids as bytes (little-endian, 32 bits).

    Null texts are empty: their only id is the end id. Only documents of more than ``size`` ids are cut.
    Rows that share an id, or have none, are documents of their own. No documents give no rows; other columns
    are ignored. The numbers of sequences are unique but not dense. Pieces are written to the shared folder once,
    so a lost executor doesn't pack a second time."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    done = stored(packed_by_task(slim, tokenizer, size, open_bins, end_id, ids), "packed-pieces")
    moves = stored(packed_again(done.filter("open_used IS NOT NULL").select("bin", "open_used"), size, open_bins), "packed-moves")
    pieces = done.filter("open_used IS NULL")
    met = pieces.join(F.broadcast(moves) if small_enough(moves, MAX_BROADCAST_MOVES) else moves, "bin", "left")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return met.select(*out, "ids") if ids else met.select(*out)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
