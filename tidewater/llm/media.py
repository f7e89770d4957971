"""Media columns: payloads in ISO base media containers, and an index of such a column.

``to_container`` wraps a payload as a track of fixed-size uncompressed 8-bit samples; ``read_container``
walks the nested boxes of such a file and decodes each track's sample tables (sizes, compact sizes, chunk
offsets, samples per chunk, durations, sync samples) into codec, duration and key-frame byte ranges without
touching the media data itself. Tables that claim more entries than their box holds count as far as they go.
Movie fragments are not decoded: samples that only fragments describe are not in the index.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, in_parts, parts_of, stored, whole_text

SAMPLE = 64  # bytes in a sample
SYNC_EVERY = 16  # samples from one key frame to the next
PER_CHUNK = 256  # samples in a chunk
RATE = 8000  # ticks a second; a sample lasts SAMPLE ticks
#: Boxes that hold boxes.
NESTED = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"])
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    n = sum(map(len, parts))
    if n + 8 < 1 << 32:
        return b"".join((struct.pack(">I", n + 8), kind, *parts))
    return b"".join((struct.pack(">I", 1), kind, struct.pack(">Q", n + 16), *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of the sample size."""
    return raw + bytes(max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE) - len(raw))


def to_container(payload: bytes) -> bytes:
    """A file with one audio track of uncompressed 8-bit samples; ``payload`` is a positive multiple of
    the sample size. The same payload always gives the same bytes."""
    n = len(payload) // SAMPLE
    ticks = n * SAMPLE
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK))
    syncs = range(1, n + 1, SYNC_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    mdat = box(b"mdat", payload)
    head = len(mdat) - len(payload)

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *range(first, first + len(payload), PER_CHUNK * SAMPLE))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(f">I{len(syncs)}I", len(syncs), *syncs)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, per, 1) for at, per in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", offsets),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ8xHHH2x", 0, 0, 1, 0, ticks, 0, 0, 0x100), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    return ftyp + mdat + moov(len(ftyp) + head)


def walk(data: memoryview, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of each box's content, outer boxes first; stops at a malformed one."""
    while start + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if n == 1 and start + 16 <= end:
            n, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif n == 0:
            n = end - start
        if n < head or start + n > end:
            return
        here = (*path, kind)
        yield here, start + head, start + n
        if kind in NESTED:
            yield from walk(data, start + head, start + n, here)
        start += n


def entries(view: memoryview, s: int, e: int, n: int, kind: str) -> list[tuple]:
    """The first ``n`` entries of a table, or as many as lie within its box."""
    size = struct.calcsize(f">{kind}")
    return list(struct.iter_unpack(f">{kind}", view[s : s + size * max(0, min(n, (e - s) // size))]))


def number(view: memoryview, s: int, e: int, kind: str = "I") -> int:
    """A number, or 0 where the box ends before it."""
    return struct.unpack_from(f">{kind}", view, s)[0] if s + struct.calcsize(f">{kind}") <= e else 0


def tracks(data: bytes) -> list[dict]:
    """Each track's tables: codec, timescale, duration, sizes, offsets, sync sample numbers."""
    view, out = memoryview(data), []
    for path, s, e in walk(view, 0, len(view)):
        kind = path[-1]
        if kind == b"trak":
            out.append({"codec": "", "scale": 0, "duration": 0, "sizes": (0, 0, ()), "chunks": (), "runs": (), "syncs": None})
            continue
        if not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"mdhd":
            at = s + 20 if e > s and view[s] == 1 else s + 12
            t["scale"], length = number(view, at, e), number(view, at + 4, e, "Q" if at == s + 20 else "I")
            t["duration"] = t["duration"] or length
        elif kind == b"stts":  # how long the samples last, in runs
            t["duration"] = sum(k * ticks for k, ticks in entries(view, s + 8, e, number(view, s + 4, e), "II")) or t["duration"]
        elif kind == b"stsd" and e - s >= 16:
            t["codec"] = bytes(view[s + 12 : s + 16]).decode("latin-1")
        elif kind == b"stsz":
            fixed, n = number(view, s + 4, e), number(view, s + 8, e)
            sizes = () if fixed else [x for (x,) in entries(view, s + 12, e, n, "I")]
            t["sizes"] = (fixed, n if fixed else len(sizes), sizes)
        elif kind == b"stz2":
            bits, n = number(view, s + 7, e, "B"), number(view, s + 8, e)
            if bits == 4:
                sizes = [x for (two,) in entries(view, s + 12, e, -(-n // 2), "B") for x in (two >> 4, two & 15)][:n]
            else:
                sizes = [x for (x,) in entries(view, s + 12, e, n, "B" if bits == 8 else "H")]
            t["sizes"] = (0, len(sizes), sizes)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = [x for (x,) in entries(view, s + 8, e, number(view, s + 4, e), "I" if kind == b"stco" else "Q")]
        elif kind == b"stsc":
            t["runs"] = entries(view, s + 8, e, number(view, s + 4, e), "III")
        elif kind == b"stss":
            t["syncs"] = {x for (x,) in entries(view, s + 8, e, number(view, s + 4, e), "I")}
    return out


def samples(t: dict, end: int) -> Iterator[tuple[int, int, bool]]:
    """(offset, size, key frame or not) of a track's samples; of samples of one fixed size, which no table lists
    one by one, those before ``end``, the file's. Without a sync table all are key frames."""
    fixed, n, sizes = t["sizes"]
    at, run = 0, 0
    for c, offset in enumerate(t["chunks"], 1):
        while run + 1 < len(t["runs"]) and t["runs"][run + 1][0] <= c:
            run += 1
        for _ in range(t["runs"][run][1] if t["runs"] else 1):
            size = fixed or (sizes[at] if at < len(sizes) else 0)
            if at >= n or fixed and offset + size > end:
                break
            at += 1
            yield offset, size, t["syncs"] is None or at in t["syncs"]
            offset += size


def read_tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, number of samples, key-frame byte ranges, and the byte
    ranges of all samples joined where they adjoin."""
    out = []
    for t in tracks(data):
        keys, ranges = [], []
        for offset, size, key in samples(t, len(data)):
            if key:
                keys.append((offset, offset + size))
            if ranges and ranges[-1][1] == offset:
                ranges[-1][1] = offset + size
            else:
                ranges.append([offset, offset + size])
        out.append({"codec": t["codec"], "timescale": t["scale"], "duration": t["duration"], "n_samples": t["sizes"][1], "keyframes": keys, "ranges": ranges})
    return out


def read_container(data: bytes) -> dict:
    """The first track as ``read_tracks`` has it; empty values for a file without one."""
    return next(iter(read_tracks(data)), {"codec": "", "timescale": 0, "duration": 0, "n_samples": 0, "keyframes": [], "ranges": []})


def with_containers(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: the text's UTF-8 bytes (null: none), padded, in a container.
    One row per row of ``docs``; equal texts give equal bytes; other columns are ignored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b):  # a container column is as large as its texts: hand it on in parts
                raw = [x.as_buffer().to_pybytes() for x in part.column(1).cast(pa.binary())]
                media = pa.array([to_container(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    return slim.mapInArrow(pack, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


MEDIA_INDEX = (
    "codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start:bigint,end:bigint>>, "
    "tracks array<struct<codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>, "
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
)


def media_index(table: DataFrame, media: str = "media") -> DataFrame:
    """The rows of ``table`` with ``media`` replaced by its index: the first track's fields and those of all
    ``tracks``, and digests of the bytes stored in it (the payload is the first track's). Null media count as
    empty ones. Columns of the table that have the index's names are replaced."""
    new = [x.split(" ")[0] for x in re.split(r", (?![^<]*>)", MEDIA_INDEX)]
    others = [c for c in table.columns if c != media and c not in new]
    table = table.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{media}`").alias("_media"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        fields = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", ranges)]
        kinds = dict(fields) | {"tracks": pa.list_(pa.struct(fields)), "payload_sha256": pa.string(), "media_sha256": pa.string()}
        for b in in_parts(batches):
            rows = {c: [] for c in new}
            for x in b.column(len(others)):
                data = x.as_py() or b""
                found = read_tracks(data)
                first = found[0] if found else read_container(b"")
                digest, n, tail = hashlib.sha256(), 0, b""
                for s, e in first["ranges"]:
                    digest.update(part := data[s:e])
                    n, tail = n + len(part), (tail + part[-SAMPLE:])[-SAMPLE:]
                shown = [{k: t[k] if k != "keyframes" else [{"start": s, "end": e} for s, e in t[k]] for k, _ in fields} for t in found]
                values = (shown[0] if shown else {k: first[k] for k, _ in fields}) | {"tracks": shown, "payload_bytes": n, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail)}
                for k, v in (values | {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}).items():
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items())], names=[*others, *rows])

    kept = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in others)
    return table.mapInArrow(index, f"{kept}, {MEDIA_INDEX}" if kept else MEDIA_INDEX)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_index(stored(with_containers(documents(spark, sf_dir)), "media", "zstd"))
    spans = F.transform("keyframes", lambda k: F.concat_ws("-", k["start"], k["end"]))
    feature = F.concat_ws(";", "codec", F.concat_ws("/", "duration", "timescale"), "n_samples", F.size("keyframes"), F.crc32(F.array_join(spans, ",").cast("binary")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op6_media_columns": op6_media_columns}
