"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: any occurrence within the budget
holds at least one piece unchanged. An automaton over all pieces finds the exact hits in one pass over
each whole text; around a hit, Myers' bit-parallel algorithm computes the edit distance of the item to
the best matching stretch, and those within the budget are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, in_parts, parts_of, stored
from tidewater.llm.text_spans import folded

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.08
#: Items handled in one pass, and about their characters: what the driver and a task hold in memory. More take
#: more passes, in blocks.
ITEMS_PER_PASS, CHARS_PER_PASS = 20_000, 20_000_000
WHITE = re.compile(r"[^\S ]")


def comparable(text: str) -> str:
    """Lower case and every white-space character a blank; the same length, so positions hold."""
    return WHITE.sub(" ", folded(text))


def at_word_edges(text: str, lo: int, hi: int) -> bool:
    """Whether a stretch neither begins nor ends inside a run of letters or digits."""
    return not (lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum() or hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` pieces of as equal length as can be."""
    n = len(item)
    cuts = [n * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers' search: the least edit distance of the pattern to any stretch of ``text``, and the end of
    the first stretch that has it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """All items of one pass: their pieces in one automaton, and the verification of hits."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = comparable(text or "").strip()
            if not item:
                continue  # an empty item occurs nowhere
            budget = int(len(item) * rate)
            for offset, piece in pieces(item, budget):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, item, budget))
        self.tables: dict[int, tuple[dict, dict]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, edit distance, start, end) of each item's best match in a text; ties: the first."""
        if not self.items:
            return []
        t = comparable(text)
        diagonals: dict[int, set[int]] = {}
        for end, (n, at) in self.automaton.iter(t):
            for k, offset in at:
                diagonals.setdefault(k, set()).add(end + 1 - n - offset)
        return [(self.items[k][0], *m) for k, starts in sorted(diagonals.items()) if (m := self.verify(t, k, sorted(starts)))]

    def verify(self, t: str, k: int, starts: list[int]) -> tuple[int, int, int] | None:
        _, item, budget = self.items[k]
        m, found = len(item), None
        for s in starts:
            if s >= 0 and t.startswith(item, s) and (budget or at_word_edges(t, s, s + m)):
                return 0, s, s + m
        if not budget:
            return None
        windows: list[list[int]] = []
        for s in starts:  # windows that overlap are searched together
            lo, hi = max(0, s - budget), min(len(t), s + m + budget)
            if windows and lo <= windows[-1][1] - m:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        if k not in self.tables:
            self.tables[k] = masks(item), masks(item[::-1])
        ahead, back = self.tables[k]
        for lo, hi in windows:
            distance, end = best_end(ahead, m, t[lo:hi])
            if distance <= budget and (found is None or distance < found[0]):
                _, length = best_end(back, m, t[max(lo, lo + end - m - distance) : lo + end][::-1])
                found = (distance, lo + end - length, lo + end)
        return found


def item_blocks(items: DataFrame) -> Iterator[tuple[bool, list]]:
    """Whether it is the last, and the rows of (item_id, text) with how often each occurs, at most about
    ``ITEMS_PER_PASS`` at a time; one block at least. Equal items are one row, so a block's bound holds for them too; a
    single item is never cut, whatever its length."""
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_PER_PASS), -(-chars // CHARS_PER_PASS))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).orderBy("item_id", "text")
        yield k == blocks - 1, [tuple(r) for r in part.collect()]


def holds_none(items: list, rate: float):
    """A function of a text column: whether a text holds none of the items."""

    @F.arrow_udf("boolean")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher([(i, t) for i, t, _ in items], rate)
        for texts in columns:
            yield pa.array([not (t and matcher.find(t)) for part in parts_of(texts) for t in part.to_pylist()], pa.bool_())

    return judge


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged. Each row is judged by its own text, whatever its id:
    null and repeated ids make no difference. Null and empty texts hold none. Only texts go to Python; with
    more than one block of items, what a block keeps is stored before the next."""
    for last, some in item_blocks(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))):
        docs = docs.filter(holds_none(some, rate)(F.col(text)))
        if not last:
            docs = stored(docs, "clean")
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and item that occurs in it within the budget: doc_id, item_id, distance,
    start, end (code points); of several occurrences, the first of the least distance. Clean documents have no
    row, nor have null and empty texts or items; equal rows of ``docs`` each have theirs, equal items too, and
    null ids of either stay null. An item too short for a single edit has to stand at word edges. Texts are
    read whole. Other columns are ignored.

    Items are held whole by the driver and each task, ``ITEMS_PER_PASS`` at a time, so memory is bounded
    whatever the benchmark's size; the documents are read once for each block of items, and its rows are
    stored before the next block is fetched."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).filter("text <> ''")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    numbers = items.schema["item_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    items = items.withColumn("item_id", F.col("item_id").cast("bigint" if numbers else "string"))
    item_type = pa.int64() if numbers else pa.string()
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id {'bigint' if numbers else 'string'}, distance int, start bigint, end bigint"
    out = None
    for last, some in item_blocks(items):

        def search(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(k, t) for k, (_, t, _) in enumerate(some)], rate)
            for b in in_parts(batches):
                rows = [(n, some[k][0], *m) for n, t in enumerate(b.column(1).to_pylist()) for k, *m in matcher.find(t) for _ in range(some[k][2])]
                if rows:
                    at, item, distance, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at)), pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        names=["doc_id", "item_id", "distance", "start", "end"],
                    )

        found = slim.mapInArrow(search, schema)
        found = found if last else stored(found, "contaminated")
        out = found if out is None else out.unionByName(found)
    return out


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_contamination": op2_contamination}
