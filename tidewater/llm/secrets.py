"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at the hits only, checksum validation.

The automaton runs over each whole text; a pattern is tried only at the places where its keyword was
found, left to right without overlap, which gives what a leftmost non-overlapping search gives because
every match has to begin with a keyword. Runs of hexadecimal digits have no keyword and are searched
for directly. Tokens whose format embeds a checksum are reported only if it holds; a web token only if its
header decodes, which is no checksum.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, in_parts, whole_text
from tidewater.llm.text_spans import folded

BASE_KINDS = ["assign", "access", "hex"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_base62(token: str) -> bool:
    """The last six characters are the base-62 crc32 of those between the prefix and them."""
    body, check = token[4:-6], token[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def base58_check(token: str) -> bool:
    """Base-58 with the first four bytes of the double SHA-256 of the rest at its end."""
    n = 0
    for c in token:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def jwt_header(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = re.compile(r"[0-9a-f]{32,}")
#: kind: keywords (lower case), pattern anchored at the keyword, test of a match, whether it checks a checksum.
DETECTORS = {
    "assign": (["password", "passwd", "secret", "token", "api_key", "apikey"], ASSIGN, lambda m: len(m[2]) >= 8, False),
    "access": (["akia"], re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, False),
    "github": (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_base62(m[0]), True),
    "npm": (["npm_"], re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc_base62(m[0]), True),
    "slack": (["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], re.compile(r"xox[bpars]-[0-9A-Za-z-]{20,}"), lambda m: True, False),
    "stripe": (["sk_live_", "rk_live_"], re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), lambda m: True, False),
    "google": (["aiza"], re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda m: True, False),
    "jwt": (["eyj"], re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), lambda m: jwt_header(m[0]), False),
    "xprv": (["xprv"], re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), lambda m: base58_check(m[0]), True),
    "pem": (["-----begin "], re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True, False),
}
KINDS = [*BASE_KINDS, *(k for k in DETECTORS if k not in BASE_KINDS)]
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean,checked:boolean>>"


def scanner():
    """``f(text)``: the secrets of one text as (start, rank of the kind, end, kind, base, checked)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, (words, *_) in DETECTORS.items():
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    rank = {k: i for i, k in enumerate(KINDS)}

    def scan(text: str) -> list[tuple]:
        places: dict[str, list[int]] = {}
        for end, (kind, n) in automaton.iter(folded(text)):
            places.setdefault(kind, []).append(end + 1 - n)
        out = [(m.start(), rank["hex"], m.end(), "hex", True, False) for m in HEX.finditer(text)]
        for kind, starts in places.items():
            _, pattern, passes, checked = DETECTORS[kind]
            after = 0
            for s in sorted(starts):
                if s >= after and (m := pattern.match(text, s)):
                    after = m.end()
                    if passes(m):
                        out.append((s, rank[kind], after, kind, kind in BASE_KINDS, checked))
        return sorted(out)

    return scan


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, its secrets ordered by start, then kind.

    Null and empty texts have none. Rows with equal ids or texts each keep their own row; other columns
    are ignored. Texts are scanned whole: memory is one Arrow batch, time linear in the text.
    """

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        fields = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("checked", pa.bool_())]))
        names = [f.name for f in fields.value_type]
        for b in in_parts(batches):
            found = [[dict(zip(names, x, strict=True)) for x in scan(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, fields)], names=["doc_id", "found"])

    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    return slim.mapInArrow(scan_batches, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, found {SPANS}")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("found", lambda x: x["base"])
    counts = [count_of(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["checked"])).cast("long").alias("n_checked"),
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
