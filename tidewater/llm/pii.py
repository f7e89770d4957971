"""Personal data: base patterns, then bootstrapped contextual extraction.

One pass over the texts finds the base entities (the seeds) and every other identifier-like token (a word
with a digit or an at sign, also one spelled out in brackets, or a run of digit groups), each with its neighbouring words. Spark then scores the bipartite
graph of lexical patterns (the word before or after a place, the two before, the two around) and instances
(what stands there) in rounds: a pattern is worth the share of its
distinct instances that are known entities of its kind, an instance the best pattern that extracts it;
instances believed in one round count as known in the next. Identifier-like tokens that a
high-confidence pattern extracts are reported as kind ``ctx_<kind>``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, in_parts, stored, whole_text
from tidewater.llm.secrets import count_of, digest

BASE_KINDS = ["email", "ip", "card", "phone"]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>#$%&*|"
OPENING = EDGE.replace("(", "")
GROUP = re.compile(r"[(+]*[0-9][0-9+/().-]*")  # a word that may be a group of a longer number
SIGNED = re.compile(r"@|[(\[{<]at[)\]}>]", re.IGNORECASE)  # what else makes a word identifier-like: an at sign, also a veiled one
PATTERNS = ["left", "both", "before", "after"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the local part reaches back to the first
    character that it can't have, or to the end of the match before."""
    after, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > after and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            yield s, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_entities(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def places(text: str, seeds: list[tuple[int, int, str]], min_len: int) -> list[tuple]:
    """Seeds, several in one word too, and identifier-like tokens that touch no word of a seed: words of
    ``min_len`` characters or more with a digit or an at sign inside, and runs of digit groups parted by single blanks. Each with
    its contexts: (start, end, kind or None, token, left, both, before, after)."""
    if not seeds and not any(c.isdigit() for c in text) and not SIGNED.search(text):
        return []
    words = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts, spots, taken = [s for s, _ in words], [], set()

    def word(n: int) -> str:
        return text[words[n][0] : words[n][1]].strip(EDGE).lower() if 0 <= n < len(words) else ""

    def add(i: int, j: int, start: int, end: int, kind: str | None) -> None:
        """A place in the words i to j."""
        last, following = word(i - 1), word(j + 1)
        spots.append((start, end, kind, text[start:end], f"{word(i - 2)} {last}", f"{last} _ {following}", f"{last} _" if last else None, f"_ {following}" if following else None))

    for start, end, kind in sorted(seeds):
        i, j = bisect_right(starts, start) - 1, bisect_left(starts, end) - 1
        taken.update(range(i, j + 1))
        add(i, j, start, end, kind)
    def goes_on(j: int, first: bool) -> bool:
        """Whether the words j and j + 1 are groups of one number."""
        if j + 1 == len(words) or j + 1 in taken or text[words[j][1] : words[j + 1][0]] != " ":
            return False
        one, two = (text[s:e] for s, e in words[j : j + 2])
        return one[-1] != "." and bool(GROUP.fullmatch(one.lstrip(OPENING) if first else one) and GROUP.fullmatch(two.rstrip(EDGE)))

    i = 0
    while i < len(words):
        s, e = words[i]
        core, j = text[s:e].strip(EDGE), i
        if i not in taken and (any(c.isdigit() for c in core) or SIGNED.search(core)):
            while goes_on(j, j == i):
                j += 1
            if j > i:
                add(i, j, e - len(text[s:e].lstrip(OPENING)), words[j][0] + len(text[slice(*words[j])].rstrip(EDGE)), None)
            elif len(core) >= min_len:
                at = text.index(core, s)
                add(i, i, at, at + len(core), None)
        i = j + 1
    return spots


def find_identifiers(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_len: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``found`` (base entities by start, then kind) and ``spots``
    (places for the bootstrapping). Null and empty texts have none; other columns are ignored."""
    rank = {k: i for i, k in enumerate(BASE_KINDS)}
    span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("token", pa.string()), *((p, pa.string()) for p in PATTERNS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            found, spots = [], []
            for t in b.column(1).to_pylist():
                seeds = base_entities(t) if t else []
                found.append([dict(zip(("start", "rank", "end", "kind"), x, strict=True)) for x in sorted((s, rank[k], e, k) for s, e, k in seeds)])
                spots.append([dict(zip(("start", "end", "kind", "token", *PATTERNS), x, strict=True)) for x in (places(t, seeds, min_len) if t else [])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span)), pa.array(spots, pa.list_(spot))], names=["doc_id", "found", "spots"])

    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    return slim.mapInArrow(
        scan,
        f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, found array<struct<start:bigint,rank:int,end:bigint,kind:string>>, "
        f"spots array<struct<start:bigint,end:bigint,kind:string,token:string,{','.join(f'{p}:string' for p in PATTERNS)}>>",
    )


def bootstrap(spots: DataFrame, rounds: int = 2, min_seeds: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, confidence) of the high-confidence patterns. ``spots``: kind, token, left, both, before, after.

    A pattern counts from ``min_seeds`` distinct known instances. Its confidence for a kind is the summed
    belief of its distinct instances in that kind over their number, less one pseudo-instance. Hot
    contexts are no hot tasks: (pattern, instance) pairs are counted by partial aggregation, and beliefs
    meet them by joins on the instance, which adaptive execution can split."""
    pairs = stored(
        spots.select("kind", "token", F.explode(F.array(*PATTERNS)).alias("pattern"))
        .filter(F.length(F.trim(F.regexp_replace("pattern", "_", ""))) > 0)
        .groupBy("pattern", "token").agg(F.max("kind").alias("seed")),
        "pii-graph",
    )
    beliefs = pairs.filter("seed IS NOT NULL").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    patterns = None
    for _ in range(rounds):
        sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
        known = pairs.join(beliefs, "token").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count("*").alias("k"))
        scored = known.filter(F.col("k") >= min_seeds).join(sizes, "pattern")
        patterns = scored.select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).filter(F.col("confidence") >= min_confidence)
        fresh = pairs.filter("seed IS NULL").join(patterns, "pattern").groupBy("token").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("belief"))
        seeds = pairs.filter("seed IS NOT NULL").select("token", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
        beliefs = seeds.unionByName(fresh)
    return patterns


def personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``: base entities and contextual finds, by start,
    then kind. Repeated rows keep a row each, also where ids are equal."""
    scanned = stored(find_identifiers(docs, text, id_col).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    spots = scanned.select("row", F.explode("spots").alias("s")).select("row", "s.*")
    patterns = bootstrap(spots, **options)
    unseen = spots.filter("kind IS NULL").select("row", "start", "end", F.explode(F.array(*PATTERNS)).alias("pattern"))
    finds = (
        unseen.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(BASE_KINDS)).alias("rank"), "end", F.concat(F.lit("ctx_"), "kind").alias("kind"))).alias("more"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return scanned.select("row", "doc_id", "found").join(finds, "row", "left").select("doc_id", F.array_sort(F.concat("found", F.coalesce("more", none))).alias("found"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    base = F.filter("found", lambda x: x["rank"] < len(BASE_KINDS))
    counts = [count_of(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


QUERIES = {"op9_personal_data": op9_personal_data}
