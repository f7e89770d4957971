"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares two fragments (a word, or single letters in a row read as one word) by the three-letter
subsequences they share, gaps allowed within a short window and discounted by their length, so an insult
with inserted or replaced characters stays close to the plain one. A mark before the first letter counts as
a letter, so how a word begins tells more than the same letters inside a longer one. Landmarks are fragments of the labelled
sample; the machine works in their Nyström feature space. It is trained on labelled sentences in the
multiple-instance way: a sentence of a toxic document counts by its most telling fragment (the witness),
and witnesses are chosen again by the machine's own scores.

The machine's decision value of a fragment is linear in kernel values against landmarks, and those are
linear in the fragment's subsequence weights; so training folds landmarks and weights into one table of
weights by subsequence, and scoring a fragment takes a few look-ups. Each task scores a distinct fragment
once, within a bounded cache. A document's probability comes from its strongest fragments, each by how many
fragments at least as strong a clean document of its size has on average: a long text has a few accidental
likenesses, and an insult that clean texts never come near counts at any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import crc_mod, documents, parts_of
from tidewater.llm.svm import fit_svm

SYMBOLS = 65  # letters are told apart in so many classes; 0 is no letter, the last the mark before a fragment
MARK = "\x02"
WINDOW = 6  # a subsequence spans at most so many characters
DECAY = 0.6
OFFSETS = [(a, b) for a in range(1, WINDOW - 1) for b in range(a + 1, WINDOW)]
#: Documents of each label that the machine is trained on, at most about so many.
SAMPLE_PER_LABEL = 2000
LANDMARKS = 512
STRONGEST = 3  # fragments by which a document is judged
EDGES = np.linspace(-3, 3, 601)  # of margins, for the clean documents' histogram
LEAST, MOST = -3.0, 9.0  # bounds of a fragment's evidence; one that a document lacks has the least
TELLING, TELLING_DOCS = 6.0, 3  # standard deviations, and toxic documents, that a telling fragment needs at most
BACKGROUND = 12_000  # fragments without a known toxic association in the training sample
CACHE_FRAGMENTS = 400_000
PIECE, OVERLAP = 64, 16  # a longer fragment counts by its overlapping pieces, so scripts without blanks need no more memory
THRESHOLD = 0.7

SENTENCE = re.compile(r"[.!?\n]+")
INSIDE = re.compile(r"[^\W_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .*_-]+){3,}[^\W\d_](?!\S)")
#: Digits and signs read as letters.
LOOKS_LIKE = str.maketrans("0134578@$", "oieastbas")
DISGUISED = re.compile("[0134578@$]")

_CODES = np.zeros(0x110000, np.uint8)
_CODES[: 0x300] = [(1 + (ord(c) - 97) if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0) for c in map(chr, range(0x300))]
_CODES[0x300:] = 27 + np.arange(0x300, 0x110000) % 37
_CODES[ord(MARK)] = SYMBOLS - 1


def fragments(text: str) -> set[str]:
    """The distinct fragments of a text: its words in lower case without edge punctuation, words with signs
    inside also without them, and runs of single letters joined."""
    out: set[str] = set()
    lower = text.lower()
    for token in set(lower.split()):
        if token.isalpha():
            out.add(token)
            continue
        if DISGUISED.search(token):
            token = token.translate(LOOKS_LIKE)
        parts = INSIDE.findall(token)
        out.update(parts)
        if len(parts) > 1:
            out.add("".join(parts))
    for m in SPACED.finditer(lower):
        out.add("".join(INSIDE.findall(m[0])))
    cut = ([f] if len(f) <= PIECE else (f[k : k + PIECE] for k in range(0, len(f) - OVERLAP, PIECE - OVERLAP)) for f in out)
    return {f for parts in cut for f in parts if len(f) >= 3}


def marked(words: list[str]) -> list[str]:
    return [MARK + w for w in words]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight) of all distinct subsequences of each word, by word, then code."""
    lengths = np.array([len(w) for w in words])
    flat = _CODES[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # characters from here to the word's end
    keys, weights = [], []
    for a, b in OFFSETS:
        at = np.flatnonzero(left > b)
        x, y, z = flat[at], flat[at + a], flat[at + b]
        real = (x > 0) & (y > 0) & (z > 0)
        keys.append((owner[at] * SYMBOLS**3 + (x * SYMBOLS + y) * SYMBOLS + z)[real])
        weights.append(np.full(int(real.sum()), DECAY ** (b + 1 - 3)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, weight = key[first], np.add.reduceat(weight, first)
    return key // SYMBOLS**3, key % SYMBOLS**3, weight


def norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(owner, weight**2, n), 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalized kernel values of ``words`` (rows) against ``landmarks``."""
    owner, code, weight = subsequences(marked(landmarks))
    used = np.unique(code)
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # the last row is for subsequences that no landmark has
    table[np.searchsorted(used, code), owner] = weight / norms(owner, weight, len(landmarks))[owner]
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 256):
        owner, code, weight = subsequences(part := marked(words[lo : lo + 256]))
        if len(code) and len(used):
            at = np.searchsorted(used, code)
            at[used[np.minimum(at, len(used) - 1)] != code] = len(used)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            share = (weight / norms(owner, weight, len(part))[owner]).astype(np.float32)
            out[lo + owner[first]] = np.add.reduceat(table[at] * share[:, None], first)
    return out


@dataclass
class ToxicityModel:
    table: np.ndarray  # weights by subsequence
    bias: float
    rarity: np.ndarray  # minus the logarithm of the share of clean documents' fragments from each edge on
    calibration: np.ndarray  # of each feature of a document, and a constant

    def margins(self, words: list[str]) -> np.ndarray:
        owner, code, weight = subsequences(marked(words))
        return np.bincount(owner, self.table[code] * weight, len(words)) / norms(owner, weight, len(words)) + self.bias

    def features(self, margins: np.ndarray) -> np.ndarray:
        """Of the margins of a document's distinct fragments: the evidence of the ``STRONGEST``, falling."""
        out = np.full(STRONGEST, LEAST)
        top = np.sort(margins)[::-1][:STRONGEST]
        out[: len(top)] = np.clip(self.rarity[bins(top)] - np.log(max(1, len(margins))), LEAST, MOST)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


def bins(margins: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(EDGES, margins, "right") - 1, 0, len(EDGES) - 1)


def labelled_sentences(rows: DataFrame) -> DataFrame:
    """(toxic, words): the distinct fragments of each sentence of (toxic, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, doc, words = [], [], []
            for y, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen: set[str] = set()
                for s in SENTENCE.split(t):
                    if new := fragments(s) - seen:
                        seen |= new
                        toxic.append(y)
                        doc.append(i)
                        words.append(sorted(new))
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(doc, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "doc", "words"])

    return rows.select(F.col("toxic").cast("int"), F.xxhash64("doc_id").alias("doc"), "text").mapInArrow(cut, "toxic int, doc bigint, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, landmarks: int = LANDMARKS, rounds: int = 3) -> ToxicityModel | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Null or empty texts and null labels
    don't count, an id with several labels is toxic if one says so; None with fewer than two labels, or if no
    fragment is in more toxic documents than its share. The sample takes
    about ``per_label`` documents of each label by a hash of the id, which also bounds what is broadcast.
    A fragment is telling from a bound on that relates to the most telling one and to how many toxic documents
    there are, so few labels give a machine too; equal ones go by their letters. What it is held against is the toxic share
    of documents or of their fragments, whichever is more, since long documents hold any word more often. Spark counts the documents of each label that hold a fragment; what comes to the driver is bounded:
    associated fragments (the ``4 * landmarks`` most telling), a background by hash (``BACKGROUND`` at most), and of the
    sample's sentences that hold an associated fragment ``8 * per_label`` by hash. These bound what is learned from,
    never what is scored. The labels of the sample are broadcast uncounted: the rate bounds them in expectation."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("toxic") == 1, per_label / counts[1]).otherwise(per_label / counts[0])
    usable = docs.select("doc_id", "text").join(F.broadcast(labels.filter(u < rate)), "doc_id").filter("text IS NOT NULL AND text <> ''")
    sample = labelled_sentences(usable).persist()
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("doc").alias("n")).collect()}
    n1, n0 = taken.get(1, 0), taken.get(0, 0)
    held = sample.select("toxic", "doc", F.explode("words").alias("word")).distinct()
    stats = held.groupBy("word").agg(F.sum("toxic").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    mass = stats.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    base = max(n1 / max(1, n1 + n0), (mass["p"] or 0.0) / (mass["n"] or 1.0))
    z = (F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    scored = stats.withColumn("z", z)
    often = min(TELLING_DOCS, 1 + n1 / 50)
    best = scored.filter(F.col("p") >= often).agg(F.max("z")).first()[0] or 0.0
    telling = scored.filter((F.col("p") >= often) & (F.col("z") >= min(TELLING, best / 2))).orderBy(F.desc("z"), "word").limit(landmarks * 4).collect() if best > 0 else []
    if not telling:
        sample.unpersist()
        return None
    share = {r["word"]: (r["z"], r["p"] / r["n"]) for r in telling}
    plain = scored.filter("z < 3").orderBy(F.xxhash64("word")).limit(BACKGROUND).select("word").collect()
    plain = [r["word"] for r in plain]
    # sentences with a telling fragment, of toxic documents: the machine's candidates for witnesses
    known = F.array(*map(F.lit, share))
    positive = sample.filter((F.col("toxic") == 1) & F.arrays_overlap("words", known)).select("words").orderBy(F.xxhash64("words"), "words").limit(per_label * 8).collect()
    bags = [r["words"] for r in positive]

    chosen = [max((w for w in bag if w in share), key=lambda w: (share[w], w)) for bag in bags]
    marks = list(dict.fromkeys([w for w, _ in Counter(chosen).most_common(landmarks * 2 // 3)] + plain))[:landmarks]
    gram = kernel(marks, marks)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map is kernel values times this
    mapped = lambda words: kernel(words, marks) @ root
    background = mapped(plain)
    owner, code, weight = subsequences(marked(marks))
    weight = weight / norms(owner, weight, len(marks))[owner]
    every = sorted({v for bag in bags for v in bag})
    for _ in range(rounds):
        witnesses = sorted(set(chosen))
        spelled = witnesses + [v for x in witnesses[:2000] for v in variants(x)]
        x = np.vstack([mapped(spelled), background])
        w, bias = fit_svm(x, np.arange(len(x)) < len(spelled), c=4.0, epochs=12)
        table = np.zeros(SYMBOLS**3, np.float32)
        np.add.at(table, code, (root @ w)[owner] * weight)
        model = ToxicityModel(table, bias, np.zeros(len(EDGES)), np.zeros(STRONGEST + 1))
        margin = dict(zip(every, np.concatenate([model.margins(every[lo : lo + 20_000]) for lo in range(0, len(every), 20_000)]).tolist(), strict=True))
        chosen = [max(bag, key=lambda v: (margin[v], v)) for bag in bags]
        chosen = [v for v in chosen if margin[v] > 0 and (v in share or margin[v] > 0.5)] or witnesses
    # calibration on the sample's documents
    per_doc = sample.groupBy("doc").agg(F.max("toxic").alias("toxic"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    seen = np.zeros(len(EDGES))
    for r in clean_margins(per_doc.filter("toxic = 0").select("words"), model).groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[r["bin"]] = r["n"]
    model.rarity = -np.log((np.cumsum(seen[::-1])[::-1] + 0.5) / (seen.sum() + 1))
    rows = with_features(per_doc.select("toxic", "words"), model).toPandas()
    sample.unpersist()
    model.calibration = logistic(np.vstack(rows["features"]), rows["toxic"].to_numpy(float))
    return model


def variants(word: str) -> list[str]:
    """The word with a letter put in, doubled, at two places: how insults are often disguised."""
    k = len(word) // 2
    return [word[:k] + "x" + word[k:], word[:2] + word[1] + word[2:]] if len(word) >= 4 else []


def clean_margins(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(bin, n): how many fragments of (words) have a margin in each bin, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(EDGES), np.int64)
        for b in batches:
            for w in b.column(0).to_pylist():
                if w:
                    seen += np.bincount(bins(model.margins(w)), minlength=len(EDGES))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["bin", "n"])

    return rows.mapInArrow(run, "bin int, n bigint")


def with_features(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(toxic, features) of (toxic, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.features(model.margins(w) if w else np.zeros(0)).tolist() for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    return rows.mapInArrow(run, "toxic int, features array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge, classes weighted equally; the constant comes last."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    beta, free = np.zeros(rows.shape[1]), np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (weight * (p - y)) + ridge * len(y) * beta * free
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(ridge * len(y) * free + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score`` for each row of ``docs``; repeated rows and ids each get the same, other columns
    are ignored. Null and empty texts, and all texts without a model, score 0. Whole texts count: a document
    is scored by its ``STRONGEST`` most toxic distinct fragments and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: dict[str, float] = {}
        old: dict[str, float] = {}
        for b in batches:
            out = []
            for part in parts_of(b.column(1), 256):
                part = part.to_pylist()
                bags = [fragments(t) if t and model else set() for t in part]
                missing = set().union(*bags).difference(new) if bags else set()
                if len(new) > CACHE_FRAGMENTS:
                    new, old = {}, new
                    missing = set().union(*bags)
                new.update({w: old[w] for w in missing if w in old})
                unseen = sorted(w for w in missing if w not in old)
                for k in range(0, len(unseen), 20_000):
                    new.update(zip(some := unseen[k : k + 20_000], model.margins(some).tolist(), strict=True))
                for bag in bags:
                    if not bag:
                        out.append(0.0)
                        continue
                    out.append(float(model.probability(model.features(np.fromiter(map(new.__getitem__, bag), float, len(bag))))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    model = fit(docs, labels)
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
