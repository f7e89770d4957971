"""Alignment of two tokenizers' tokens over the same bytes, and which ids go together across a corpus.

Both tokenizers cover the same bytes of a text, so each token has a byte range. Where a token of A and a token
of B end together the text can be cut. Cuts are found by divide and conquer: in an interval that begins and
ends at cuts, the end of A's middle token is looked up among B's ends by bisection; if it isn't there, the ends
next to it are tried, outwards from the middle; the cut found splits the interval, and both halves go on. An
interval without a cut is a leaf group. All intervals of a level, of all documents of a chunk, are bisected
together as arrays.

A pair of ids is counted once for each document that links it. Counts need the whole corpus, so documents are
taken in chunks: a task writes each document's distinct pairs as numbers within its chunk's table of pairs,
which is far smaller than the sum of its documents'. Tables of chunks are summed by pair, joined back by pair
(a frequent pair has one row a chunk, and a hot one can be split), and meet the documents of their chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.cached_ids import CachedIds, PieceIds, WordIds, kept
from tidewater.llm.common import documents, in_parts, stored, whole_text
from tidewater.llm.shingles import contents

CHUNK_BYTES = 1 << 22  # of texts whose pairs are numbered together
GROUP_BYTES = 1 << 18  # of texts aligned together
NEAR = 4  # ends tried on either side of the middle, for all intervals together
DENSE = 64  # a group with more links is counted by its distinct ids


def byte_level_tokens(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level model: every byte has a visible character."""
    # The bytes that stand for themselves; the others follow from 256 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    return [bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode() for token in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))]


def piece_tokens(vocabulary: list[str]) -> list[bytes]:
    """The bytes of each piece: U+2581 is a blank, <0xHH> a byte."""
    return [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode() for p in vocabulary]


class BothIds(CachedIds):
    """Ids of both tokenizers of a worker, by the words of B: a cut before a blank that follows something other than
    white space is one for A too, whose pre-tokens begin there whatever comes before. A piece whose tokens of A or B
    don't join to a blank and the piece has no ids (None), nor has a text with such a piece."""

    def __init__(self, a: str, b: str):
        super().__init__()
        self.a, self.b = WordIds(a, True), PieceIds(b)
        self.tokens = byte_level_tokens(self.a.tokenizer), piece_tokens(self.b.vocabulary)
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in self.tokens]
        n = max(map(len, self.tokens))
        self.marked = [f"{i}{mark}" for mark in ",|;" for i in range(n)]  # decimal texts of ids, with each mark that can follow

    def pieces(self, text: str) -> list[str] | None:
        return self.b.pieces(text) if self.a.by_word else None

    def right(self, ids: list[bytes], tokens: list[bytes], lengths: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which pieces' tokens join to their bytes."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        ends = np.concatenate(([0], np.cumsum(lengths[flat])))[np.cumsum([len(x) // 4 for x in ids])]
        if b"".join(map(tokens.__getitem__, flat.tolist())) == b"".join(raw) and (ends == np.cumsum(list(map(len, raw)))).all():
            return np.ones(len(ids), bool)
        return np.array([b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) == r for x, r in zip(ids, raw, strict=True)])

    def ids_of_a(self, spaced: list[str], raw: list[bytes]) -> list[bytes]:
        """Pieces that end in something other than white space are encoded as one text, which is cut again where
        they end; all others, and all if a token reaches across, one by one."""
        closed = [k for k, t in enumerate(spaced) if not t[-1].isspace()]
        if not self.a.by_word or len(closed) < 2:
            return self.a.whole(spaced)
        flat = self.a.whole(["".join(spaced[k] for k in closed)])[0]
        ends = np.cumsum(self.lengths[0][np.frombuffer(flat, "<u4")])
        bounds = np.cumsum([len(raw[k]) for k in closed])
        at = np.minimum(np.searchsorted(ends, bounds), len(ends) - 1)
        if not (ends[at] == bounds).all():
            return self.a.whole(spaced)
        edges = [0, *(4 * (at + 1)).tolist()]
        found = dict(zip(closed, (flat[x:y] for x, y in zip(edges, edges[1:], strict=False)), strict=True))
        rest = [k for k in range(len(spaced)) if k not in found]
        found.update(zip(rest, self.a.whole([spaced[k] for k in rest]), strict=True))
        return [found[k] for k in range(len(spaced))]

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        spaced = [f" {t}" for t in texts]
        raw = [t.encode() for t in spaced]
        both = self.ids_of_a(spaced, raw), [x if t or not self.b.by_word else self.b.blank for t, x in zip(texts, self.b.whole(texts), strict=True)]
        right = np.logical_and(*[self.right(ids, tokens, lengths, raw) for ids, tokens, lengths in zip(both, self.tokens, self.lengths, strict=True)])
        return [x if good else None for x, good in zip(zip(*both, strict=True), right.tolist(), strict=True)]

    def joined(self, parts) -> tuple[bytes, bytes] | None:
        parts = list(parts)
        return None if None in parts else tuple(map(b"".join, zip(*parts, strict=True)))

    def size(self, ids) -> int:
        return len(ids[0]) + len(ids[1]) if ids else 0


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last tokens of A, last tokens of B) of each group, in order. Ends are byte offsets over all documents, one
    after another; ``first_a`` and ``first_b`` are the documents' first tokens and the total at last. Each document's
    last ends are one cut."""
    lo, hi, blo, bhi = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    some = hi > lo
    lo, hi, blo, bhi = (x[some].astype(np.int64) for x in (lo, hi, blo, bhi))
    cut_a, cut_b = [hi - 1], [bhi - 1]
    while True:
        # an interval needs two tokens on both sides to have an inner cut
        inner = (hi - lo > 1) & (bhi - blo > 1)
        lo, hi, blo, bhi = lo[inner], hi[inner], blo[inner], bhi[inner]
        if not len(lo):
            break
        middle = (lo + hi - 2) >> 1
        at, place = np.full(len(lo), -1), np.full(len(lo), -1)
        open_ = np.arange(len(lo))
        for step in [0, *(d for k in range(1, NEAR + 1) for d in (-k, k))]:
            m = middle[open_] + step
            inside = (m >= lo[open_]) & (m < hi[open_] - 1)
            rows, m = open_[inside], m[inside]
            j = np.searchsorted(ends_b, ends_a[m])
            hit = ends_b[j] == ends_a[m]
            at[rows[hit]], place[rows[hit]] = m[hit], j[hit]
            open_ = open_[at[open_] < 0]
            if not len(open_):
                break
        for k in open_[hi[open_] - lo[open_] - 1 > 2 * NEAR + 1].tolist():  # long intervals, cutless around the middle
            m = np.arange(lo[k], hi[k] - 1)
            j = blo[k] + np.searchsorted(ends_b[blo[k] : bhi[k]], ends_a[m])
            hits = np.flatnonzero(ends_b[j] == ends_a[m])
            if len(hits):
                best = hits[np.argmin(np.abs(m[hits] - middle[k]))]
                at[k], place[k] = m[best], j[best]
        found = at >= 0
        at, place = at[found], place[found]
        cut_a.append(at)
        cut_b.append(place)
        lo, hi = np.concatenate([lo[found], at + 1]), np.concatenate([at + 1, hi[found]])
        blo, bhi = np.concatenate([blo[found], place + 1]), np.concatenate([place + 1, bhi[found]])
    return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def group_links(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times) of all links of groups with first tokens ``sa`` and ``sb`` (and the totals at last):
    pair is a's id * 2^32 + b's. A group with many links gives its distinct pairs, others each link."""
    na, nb = np.diff(sa), np.diff(sb)
    few = na * nb <= DENSE
    # every A token of a small group, as often as the group has B tokens
    group = np.repeat(np.arange(len(na)), na)
    small = few[group]
    token, of = np.flatnonzero(small), group[small]
    each = nb[of]
    row = np.repeat(np.arange(len(token)), each)
    within = np.arange(len(row)) - np.repeat(starts_of(each)[:-1], each)
    whose, pair, times = [owner[of[row]]], [(a[token[row]] << 32) | b[sb[of[row]] + within]], [np.ones(len(row), np.int64)]
    for g in np.flatnonzero(~few).tolist():
        (ia, ka), (ib, kb) = (np.unique(x[s[g] : s[g + 1]], return_counts=True) for x, s in ((a, sa), (b, sb)))
        pair.append(((ia << 32)[:, None] | ib[None, :]).ravel())
        times.append((ka[:, None] * kb[None, :]).ravel())
        whose.append(np.full(len(pair[-1]), owner[g]))
    return np.concatenate(whose), np.concatenate(pair), np.concatenate(times)


def merged(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's distinct pairs in order, with their times added up."""
    if len(pair) and times.max() == 1 and owner[-1] < 1 << 31 and not (int(np.bitwise_or.reduce(pair)) & 0xFFFF0000FFFF0000):
        # single links of ids below 2^16: owner and pair in one number, which sorts faster
        packed = np.sort((owner << 32) | (pair >> 16) | (pair & 0xFFFF))
        at = np.flatnonzero(np.diff(packed, prepend=-1))
        packed, times = packed[at], np.diff(at, append=len(packed))
        return packed >> 32, ((packed & 0xFFFF0000) << 16) | (packed & 0xFFFF), times
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def align_texts(texts: list[str], both: BothIds) -> tuple:
    """For texts: (n_a, n_b, n_groups, n_links) as arrays, the groups as text, and (owner, pair, times) of the
    documents' distinct links."""
    none = np.zeros(0, np.int64)
    full = iter(both.encode([t for t in texts if t]))
    found = [next(full) if t else None for t in texts]
    ia, ib = ([np.frombuffer(x[k], "<u4").astype(np.int64) if x else none for x in found] for k in range(2))
    na, nb = (np.array(list(map(len, x)), np.int64) for x in (ia, ib))
    first_a, first_b = starts_of(na), starts_of(nb)
    ta, tb = np.concatenate([*ia, none]), np.concatenate([*ib, none])
    cut_a, cut_b = shared_cuts(np.cumsum(both.lengths[0][ta]), np.cumsum(both.lengths[1][tb]), first_a, first_b)
    sa, sb = np.concatenate(([0], cut_a + 1)), np.concatenate(([0], cut_b + 1))
    ga, gb = np.diff(sa), np.diff(sb)
    owner = np.searchsorted(first_a, cut_a, "right") - 1
    per = lambda values: np.bincount(owner, values, len(texts)).astype(np.int64)
    n_groups = np.bincount(owner, minlength=len(texts))
    # the groups' text: ids of A, then of B, each with the mark that follows it
    n = len(both.marked) // 3
    keys = np.zeros(len(ta) + len(tb), np.int64)
    at_a = np.arange(len(ta)) + np.repeat(sb[:-1], ga)
    at_b = np.arange(len(tb)) + np.repeat(sa[1:], gb)
    keys[at_a], keys[at_b] = ta, tb
    keys[at_a[cut_a]] += n
    keys[at_b[cut_b]] += 2 * n
    edges = first_a + first_b
    groups = ["".join(map(both.marked.__getitem__, keys[s:e].tolist()))[:-1] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return (na, nb, n_groups, per((ga * gb).astype(np.float64))), groups, merged(*group_links(ta, tb, sa, sb, owner))


COLUMNS = "chunk bigint, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary, i int, a bigint, b bigint, k bigint"


def aligned_chunks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, digest: bool, chunk_bytes: int) -> DataFrame:
    """Of (doc_id, text): a row for each document (``links``: its distinct pairs as numbers in its chunk's table and
    how often each is linked, compressed), and a row for each pair of each chunk: i (its number), a, b, k (the
    documents of the chunk that link it)."""
    schema = COLUMNS.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = kept(BothIds, tokenizer_a, tokenizer_b)
        press = zstandard.ZstdCompressor(1)
        chunk, held, ids, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held, ids, size
            base = starts_of(np.array([len(g) for _, g, _ in held]))
            owner, pair, times = (np.concatenate([x[2][k] + (base[j] if k == 0 else 0) for j, x in enumerate(held)]) for k in range(3))
            table, docs_of = np.unique(pair, return_counts=True)
            at = np.searchsorted(table, pair)
            edges = np.searchsorted(owner, np.arange(base[-1] + 1))
            links = []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                links.append(press.compress(np.concatenate([np.diff(at[s:e], prepend=0), times[s:e]]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))
            n, m = int(base[-1]), len(table)
            counts = [pa.array(np.concatenate([x[0][k] for x in held])) for k in range(4)]
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.concat_arrays(ids), *counts, pa.array([g for _, x, _ in held for g in x], pa.string()), pa.array(links, pa.binary()), *empty], names=names)
            empty = [pa.nulls(m, t) for t in (kind, *[pa.int64()] * 4, pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), *empty, pa.array(np.arange(m, dtype=np.int32)), pa.array(table >> 32), pa.array(table & 0xFFFFFFFF), pa.array(docs_of.astype(np.int64))], names=names)
            chunk, held, ids, size = chunk + 1, [], [], 0

        for part in in_parts(batches):
            kind, at, lo = part.schema.field("doc_id").type, contents(part.column(1))[1], 0
            while lo < part.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GROUP_BYTES, "right")) - 1)
                counts, groups, links = align_texts(part.column(1).slice(lo, hi - lo).to_pylist(), both)
                held.append((counts, [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups, links))
                ids.append(part.column(0).slice(lo, hi - lo))
                size += int(at[hi] - at[lo])
                if size >= chunk_bytes:
                    yield from flush()
                lo = hi
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) from (a, b, k) rows: in how many documents the pair is linked, and whether no pair with
    the same a is in more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("k").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))).select("a", "b", "count", "best")


def alignments(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text", id_col: str = "doc_id", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of A and B tokens that share a
    group), n_best (links whose pair is in as many documents as any pair of its A id), count_sum (of the documents
    that hold each link's pair) and ``groups``: `a1,a2|b1;a3|b2,b3` in decimal ids, or with ``digest`` its sha256.

    A (byte-level) reads a blank and the text, B (sentencepiece) the text; strings of special tokens are plain text.
    Null and empty texts, and texts whose tokens don't join to a blank and the text on both sides, have no tokens:
    zeros and ''. Rows that share an id, or have none, are documents of their own. Other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    done = stored(aligned_chunks(slim, tokenizer_a, tokenizer_b, digest, chunk_bytes), "aligned", "zstd")
    pairs = done.filter("i IS NOT NULL").select("chunk", "i", "a", "b", "k")
    known = stored(pair_counts(pairs), "aligned-pairs")
    scored = pairs.select("chunk", "i", "a", "b").join(known, ["a", "b"]).select(F.col("chunk").alias("of"), "i", "count", "best")
    rows = done.filter("i IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        order = np.argsort(right.column("i").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        open_ = zstandard.ZstdDecompressor().decompress
        n_best, total = [], []
        for x in left.column("links").to_pylist():
            numbers = np.ascontiguousarray(np.frombuffer(open_(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()
            half = len(numbers) // 2
            at, times = np.cumsum(numbers[:half]), numbers[half:]
            n_best.append(int(times[best[at]].sum()) if n else 0)
            total.append(int((times * count[at]).sum()) if n else 0)
        return left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    kind = slim.schema["doc_id"].dataType.simpleString()
    found = rows.groupBy("chunk").cogroup(scored.groupBy("of")).applyInArrow(sums, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    found = alignments(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
