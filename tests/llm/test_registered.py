"""The registered queries of the corpus operators on the smallest tables, against what their contracts say, by brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidewater.llm import contamination, language, licenses, media, pii, secrets, token_files, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, query, texts):
    got = {r["doc_id"]: r for r in query(spark, SF).collect()}
    assert got.keys() == texts.keys()
    return got


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2])))).encode()).hexdigest()


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_op1(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for d, r in rows_of(spark, licenses.op1_license_scan, texts).items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(texts[d]))
        hits = [(k, len(p.split()), label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(hits), min(starts, default=None), max(starts, default=None))
        base = sorted({x for *_, x in hits})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op3(spark, texts):
    kinds = ["assign", "access", "hex"]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for d, r in rows_of(spark, secrets.op3_secret_scan, texts).items():
        t = texts[d]
        spans = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[2] == k for x in spans) for k in kinds] and r["base_sha256"] == digest(spans, kinds)
        assert {f"{k}:{s}:{e}" for s, e, k in spans} <= set(r["spans"].split(",")) | {""}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_op9(spark, texts):
    kinds = ["email", "ip", "card", "phone"]
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    count = lambda x: sum(c.isascii() and c.isdigit() for c in x)
    good = {
        "email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "phone": lambda x: 9 <= count(x) <= 15,
        "card": lambda x: 12 <= count(x) <= 19 and luhn(re.sub("[^0-9]", "", x)),
    }
    for d, r in rows_of(spark, pii.op9_personal_data, texts).items():
        spans = [(m.start(), m.end(), k) for k, p in zip(kinds, patterns, strict=True) for m in re.finditer(p, texts[d]) if good[k](m[0])]
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[2] == k for x in spans) for k in kinds] and r["base_sha256"] == digest(spans, kinds)
        assert {f"{k}:{s}:{e}" for s, e, k in spans} <= set(r["spans"].split(",")) | {""}


def test_op5(spark, texts):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own, start = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json")), 0
    got = rows_of(spark, token_files.op5_token_files, texts)
    for d in sorted(texts):
        ids = np.array([*own.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op6(spark, texts):
    seen = {}
    for d, r in rows_of(spark, media.op6_media_columns, texts).items():
        raw = texts[d].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        made = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert seen.setdefault(texts[d], made) == made


def test_op4_and_op10(spark, texts):
    for d, r in rows_of(spark, toxicity.op4_toxicity, texts).items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    learned = {v for d, v in known.items() if v is not None and zlib.crc32(str(d).encode()) % 5}
    held, right = 0, 0
    for d, r in rows_of(spark, language.op10_language_id, texts).items():
        out = zlib.crc32(str(d).encode()) % 5 == 0
        assert r["held_out"] == out and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(c.isalpha() for c in texts[d]) else r["lang_pred"] == "und"
        if out and known[d] is not None and r["lang_pred"] != "und":
            held, right = held + 1, right + (r["lang_pred"] == known[d])
    assert held and right >= 0.9 * held


def test_op2_and_repeated_items(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in contamination.op2_contamination(spark, SF).collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x and len(x) > 40 and x in t}
    assert whole <= found
    docs = spark.createDataFrame([(1, "before " + "a passage of the benchmark that is long enough " * 2)], "doc_id long, text string")
    repeated = spark.createDataFrame([(7, "a passage of the benchmark that is long enough")] * 3 + [(8, "a passage of the benchmark that is long enough"), (9, "nothing of the kind")], "item_id long, text string")
    assert sorted(r["item_id"] for r in contamination.contaminated(docs, repeated).collect()) == [7, 7, 7, 8]
    assert contamination.clean(docs, repeated).count() == 0
