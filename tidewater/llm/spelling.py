"""Spelling variants: words one edit apart, each led to its far more frequent form.

A word is a vector of letter counts. One replaced letter moves it by a squared distance of 2, one inserted or
deleted letter by 1, so a product of two blocks of such vectors (a Gram matrix) shows the few pairs that may be
one edit apart, in blocks of equal or adjacent lengths; these are verified letter by letter.

Lengths alone would compare all words of a length with each other. An edit leaves either the first half of
the shorter word or its last half as it is, so the blocks of a length are cut further by these halves: a word
has four places (by its first and its last half, as the shorter word and as the longer one), words that share a
half share a block, and a pair is taken by its last halves only if its first halves differ. A block that a
frequent half makes big is dealt to parts by hash, and each pair of parts is a row group of its own, so no block
is gathered in one task, and no pair is listed: a task returns sums and the best partner for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, checkpointed, documents, drop_stored, stored, whole_text

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
TYPO_EVERY = 31
BLOCK = 512  # words of a block; from four times as many on it is dealt to parts
TILE = 1024  # words of a tile of a Gram matrix
#: The letters of words, as a class of the regular expression.
LETTERS = r"A-Za-zÀ-ÿ"


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST_LETTERS, typo_every: int | None = None) -> DataFrame:
    """(word): a row for each maximal run of letters of at least ``least`` code points, A-Z in lower case. With
    ``typo_every``, where it divides h, the crc32 of id, colon and run, the run loses its code point h modulo its
    length (a null id is the empty text); runs that are too short then go."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole_text(text), F.lit(f"([{LETTERS}]{{{least},}}+)"))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    if typo_every is None:
        return runs.select(F.col("run").alias("word"))
    h, n = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.char_length("run")
    at = (h % n).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return runs.select(F.when(h % typo_every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def vocabulary(occurrences: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more. Null and empty words go."""
    return occurrences.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def halves(vocab: DataFrame) -> DataFrame:
    """(length, side, half, longer, word, n): each word in its four places: as the shorter word and as the longer
    one (``length`` is the shorter one's), by the first and the last half of that length."""

    def sides(length: Column, longer: bool) -> list[Column]:
        h = F.floor(length / 2).cast("int")
        rest = (length - h).cast("int")
        first, last = F.substring(F.col("word"), F.lit(1), h), F.substring(F.col("word"), F.char_length("word") - rest + 1, rest)
        return [F.struct(length.alias("length"), F.lit(side).alias("side"), half.alias("half"), F.lit(longer).alias("longer")) for side, half in (("first", first), ("last", last))]

    n = F.char_length("word")
    return vocab.select(F.explode(F.array(*sides(n, False), *sides(n - 1, True))).alias("x"), "word", "n").select("x.*", "word", "n")


def blocks(rows: DataFrame) -> DataFrame:
    """(block, second, longer, word, n): the rows of a length and side dealt by their halves to blocks of about
    ``BLOCK`` words, where a half is never cut; blocks that are far bigger (of frequent halves) in pairs of parts,
    each part with itself and with every other (``second``: the other part's rows)."""
    of_length = rows.groupBy("length", "side").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("longer").alias("all_longer")).filter("NOT all_longer").drop("all_longer")
    met = rows.join(of_length, ["length", "side"]).withColumn("bucket", F.pmod(F.xxhash64("half"), "blocks").cast("int"))
    key = ["length", "side", "bucket"]
    sizes = met.groupBy(*key).agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("parts"))
    met = met.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.concat_ws("/", *key, F.least("part", "other"), F.greatest("part", "other"))
    return met.select(block.alias("block"), (F.col("part") > F.col("other")).alias("second"), "longer", "word", "n")


def letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def near(a: list[str], b: list[str], side: str) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words ``a`` (all of one length) and ``b`` (all of that or one more) that are one edit apart and
    share the half of ``side``; for the last one, only those whose first halves differ."""
    if not a or not b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short, long = letters(a), letters(b)
    size, more = short.shape[1], long.shape[1] - short.shape[1]
    half = size // 2
    used, code = np.unique(np.concatenate([short.ravel(), long.ravel()]), return_inverse=True)
    counts = []
    for x, at in ((short, code[: short.size]), (long, code[short.size :])):
        counts.append(np.bincount(at + np.repeat(np.arange(len(x)) * len(used), x.shape[1]), minlength=len(x) * len(used)).reshape(len(x), -1).astype(np.float32))
    squares = [(c * c).sum(1) for c in counts]
    left, right = [], []
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            gram = counts[0][i : i + TILE] @ counts[1][j : j + TILE].T
            # squared distance at most 2: x.x + y.y - 2 x.y
            p, q = np.nonzero(2 * gram >= squares[0][i : i + TILE, None] + squares[1][None, j : j + TILE] - 2)
            x, y = short[p + i], long[q + j]
            same, shifted = x == y[:, :size], x == y[:, more:]
            first = same[:, :half].all(1)
            good = first if side == "first" else ~first & shifted[:, half:].all(1)
            if more:
                good &= np.cumprod(same, 1).sum(1) + np.cumprod(shifted[:, ::-1], 1).sum(1) >= size
            else:
                good &= same.sum(1) == size - 1
            left.append(p[good] + i)
            right.append(q[good] + j)
    return np.concatenate(left), np.concatenate(right)


def partners(dealt: DataFrame) -> DataFrame:
    """(word, k, best, best_n): for each word of each block its number of near words there, and the most
    frequent of them (ties: the first in code-point order)."""

    def compare(t: pa.Table) -> pa.RecordBatch:
        side = t.column("block")[0].as_py().split("/", 2)[1]
        w, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        second, longer = t.column("second").to_numpy(), t.column("longer").to_numpy()
        found = []
        split = second.any()
        for x, y in ((False, True), (True, False)) if split else ((False, False),):
            a, b = np.flatnonzero(~longer & (second == x)), np.flatnonzero(longer & (second == y))
            found.append([ids[k] for ids, k in zip((a, b), near([w[i] for i in a], [w[i] for i in b], side), strict=True)])
        a = np.flatnonzero(~longer & ~second)
        b = np.flatnonzero(~longer & second) if split else a
        p, q = (ids[k] for ids, k in zip((a, b), near([w[i] for i in a], [w[i] for i in b], side), strict=True))
        found.append((p, q) if split else (p[p < q], q[p < q]))
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        own, other = np.concatenate([p, q]), np.concatenate([q, p])
        rank = np.empty(len(w), np.int64)
        rank[sorted(range(len(w)), key=lambda i: (-n[i], w[i]))] = np.arange(len(w))
        order = np.lexsort((rank[other], own))
        own, other = own[order], other[order]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        k = np.diff(at, append=len(own))
        rows = [[w[i] for i in own[at]], k, [w[i] for i in other[at]], n[other[at]]]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["word", "k", "best", "best_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            if held and len(keys) and held[-1].column(0)[0].as_py() != keys[0]:
                yield compare(pa.Table.from_batches(held))
                held.clear()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                if hi < len(keys):
                    yield compare(pa.Table.from_batches(held))
                    held.clear()
        if held:
            yield compare(pa.Table.from_batches(held))

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "word string, k bigint, best string, best_n bigint")


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of (word, n), words distinct and of one letter or more: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the
    near word of largest n (ties: the smallest in code-point order) if its n is at least ``ratio`` times the word's,
    else null; ``root`` follows forms to the last. A form is ``ratio`` times as frequent as its word, so a chain is
    never longer than the logarithm of the largest n, and each round of joins halves it. An empty table gives no
    rows; other columns are ignored."""
    vocab = stored(vocab.select("word", "n"), "spelling-words")
    found = partners(blocks(halves(vocab))).groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("x"))
    enough = -F.col("x.rank") >= ratio * F.col("n")
    known = vocab.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("x.best")).alias("form"), F.when(enough, -F.col("x.rank")).alias("form_n"))
    known = stored(known, "spelling-forms")
    drop_stored(vocab)
    leads = checkpointed(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        nexts = leads.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = checkpointed(leads.join(nexts, leads["root"] == nexts["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        leads = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return known.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(words(documents(spark, sf_dir), typo_every=TYPO_EVERY)))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

#: Near words by patterns with one open place and by deleted places; crc32 by its table of 256 entries, which a
#: recursion makes from the polynomial.
ORACLE_SQL = {
    "op12_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'),
    lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM runs, tab
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS c FROM places),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM (SELECT *, word[:i - 1] || '?' || word[i + 1:] AS c FROM places) a JOIN (SELECT *, word[:i - 1] || '?' || word[i + 1:] AS c FROM places) b ON a.c = b.c AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.c
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.c
), best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY a),
pick AS (SELECT p.a, min(encode(p.b)) AS f FROM pairs p JOIN best ON best.a = p.a AND best.top = p.n GROUP BY p.a),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN decode(f) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best ON best.a = w.word LEFT JOIN pick ON pick.a = w.word
), chain AS (
  SELECT word, word AS at, form AS next FROM known
  UNION ALL SELECT c.word, c.next, k.form FROM chain c JOIN known k ON k.word = c.next
)
SELECT k.word, k.form, c.at AS root, k.n, CAST(k.n_near AS BIGINT) AS n_near, k.form_n FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL
""",
}
