"""Language identification in two steps: the language family, then one-versus-one linear support vector
machines among the languages of that family.

Features are hashed byte trigrams of the lower-cased letters, as shares of all trigrams of the text. The
machines are trained on a bounded sample of labelled rows; scoring is one pass over each whole
text inside Arrow batches, and only the texts go to Python.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import crc_mod, documents, in_parts, parts_of
from tidewater.llm.svm import fit_svm

DIM_BITS = 12
PIECE = 1 << 20
#: Labelled rows that a classifier is fitted on, at most about so many for each language.
SAMPLE_PER_LANGUAGE = 500
SAMPLE_TOTAL = 4000  # of all languages together, about, but a row of each: 66 MB of features

#: Families of languages, by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "da de en is nl no sv".split(),
    "romance": "ca es fr gl it pt ro".split(),
    "slavic": "bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the UTF-8 bytes of the text in lower case, a piece at a time; all ASCII but letters
    as blanks."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    for lo in range(0, max(1, len(raw) - 2), PIECE):
        wide = FOLD[raw[lo : lo + PIECE + 2]].astype(np.uint32)
        yield ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)


def shares(text: str) -> np.ndarray:
    """Each hashed trigram's share of the text, in thousandths, as 32-bit floats."""
    n = np.zeros(1 << DIM_BITS)
    for h in trigrams(text):
        n += np.bincount(h, minlength=1 << DIM_BITS)
    return (1000 * n / max(1.0, n.sum())).astype(np.float32)


@dataclass
class Machines:
    """One-versus-one machines: a positive margin means the first of the pair."""

    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)


@dataclass
class LanguageModel:
    families: dict[str, list[str]]  # learned languages by family
    machines: Machines

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.machines.pairs:
            return np.zeros((1 << DIM_BITS, 0), np.float32), np.zeros(0)
        return np.stack(self.machines.weights, 1).astype(np.float32), np.array(self.machines.biases)

    def decide(self, margins: np.ndarray, among: list[str]) -> tuple[str, float]:
        """The member of ``among`` with the most wins, then the largest sum of margins; and its confidence,
        the logistic of its smallest margin against another."""
        if len(among) == 1:
            return among[0], 1.0
        wins, total, least = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0), dict.fromkeys(among, np.inf)
        for (a, b), m in zip(self.machines.pairs, margins, strict=True):
            if a in wins and b in wins:
                for x, y in ((a, m), (b, -m)):
                    wins[x] += y > 0
                    total[x] += y
                    least[x] = min(least[x], y)
        best = max(among, key=lambda x: (wins[x], total[x]))
        return best, float(1 / (1 + np.exp(-np.clip(2 * least[best], -30, 30))))

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        names = sorted(self.families)
        family, p = self.decide(margins, names) if len(names) > 1 else (names[0], 1.0)
        lang, q = self.decide(margins, self.families[family])
        return lang, p * q


def features(labelled: DataFrame) -> DataFrame:
    """(lang, x) from (lang, text): trigram shares in thousandths, 32-bit floats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shares(t) for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], names=["lang", "x"])

    return labelled.select("lang", "text").mapInArrow(count, "lang string, x array<float>")


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """Fit on (doc_id, text, lang). Rows with a null or empty text or a null language don't count; None if
    no row is left. The sample takes the rows with the smallest hashes of their ids, about ``per_language``
    of each language or an equal share of ``SAMPLE_TOTAL`` if that is less, found by a rate for each
    language: no sort, and no language meets in one task. Every language is learned, by its row of the
    smallest hash at least; machines grow with the square of the languages that are families of their own."""
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    known = labelled.filter("lang IS NOT NULL AND text <> ''").select("lang", "text", u.alias("u"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()
    if not counts:
        return None
    share = min(per_language, SAMPLE_TOTAL / len(counts))
    rates = labelled.sparkSession.createDataFrame([(r["lang"], max(share / r["n"], r["least"])) for r in counts], "lang string, rate double")
    points = features(known.join(F.broadcast(rates), "lang").filter("u <= rate").select("lang", "text")).toArrow()
    if not points.num_rows:
        return None
    langs = np.array(points.column("lang").to_pylist())
    x = np.concatenate([c.flatten().to_numpy() for c in points.column("x").chunks]).reshape(-1, 1 << DIM_BITS)
    del points
    order = np.lexsort(([zlib.crc32(r) for r in x], langs))  # the same order whatever the partitions
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        families.setdefault(FAMILY_OF.get(lang, f"family of {lang}"), []).append(lang)
    machines = Machines()
    tasks = [(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    tasks += [(a, b, [a], [b]) for group in families.values() for a, b in combinations(group, 2)]
    for a, b, these, those in tasks:
        weights, bias = fit_svm(x, np.isin(langs, these), order[np.isin(langs[order], these + those)])
        machines.pairs.append((a, b))
        machines.weights.append(weights)
        machines.biases.append(bias)
    return LanguageModel(families, machines)


def predicted(text: str | Column, model: LanguageModel | None) -> Column:
    """A struct of ``lang`` and ``score`` for each text: ``und`` with score 0 for texts that are null or have
    no letter (Unicode's L categories), and for all without a model."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def predict_texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}").search
        weights, biases = model.matrix() if model else (None, None)
        for texts in columns:
            found = []
            for part in parts_of(texts):
                for t in part.to_pylist():
                    known = model is not None and t is not None and letter(t)
                    found.append(model.predict(shares(t) @ weights + biases) if known else ("und", 0.0))
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    # "nondeterministic" keeps the optimizer from predicting once for a filter and again for its column
    return predict_texts.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (replaced if there are such columns), as ``predicted``
    has them. One row per row: repeated rows and ids each get the same. Texts count whole; equal counts of
    wins go to the larger sum of margins, then to the first language by name."""
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], predicted(text, model).alias("lang_score"))
    return kept.select(*[F.col(f"`{c}`") for c in names], F.col("lang_score.lang").alias("lang_pred"), F.col("lang_score.score").alias("lang_score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op10_language_id": op10_language_id}
