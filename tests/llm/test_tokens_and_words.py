"""Token alignment, spelling variants and packing: brute force over whole results, and the edge cases of each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import packing, spelling, token_alignment
from tidewater.llm.cached_ids import FoldedIds, PieceIds, WordIds

tokenizers_files = pytest.importorskip("public_tokenizers")
BYTE, PIECE, FOLDED = (tokenizers_files.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"

#: Clashing names: columns that the operators use themselves.
SCHEMA = "doc_id long, text string, chunk string, a int, word string, n int, bin int, offset int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1, 1, 1, "x") for r in rows], SCHEMA)


def odd_texts(n=300, seed=3):
    rnd = random.Random(seed)
    parts = list("aAbÉßµª²1 \n\t's.,!ΣİΏ \xa0\x1c日本\x00") + ["<|endoftext|>", "<s>", "the ", "'ll", "  ", "▁", "ﬁ", "é"]
    return [None, "", " ", "  ", "\n", "a", "<|endoftext|>", "y" * 400, "日" * 300, "naïve " * 3000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 50))) for _ in range(n)]


def test_cached_ids_are_the_tokenizers_own():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t or "" for t in odd_texts(3000)]
    plain, own, folded = Tokenizer.from_file(BYTE), Tokenizer.from_file(BYTE), Tokenizer.from_file(FOLDED)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for cached, want in (
        (WordIds(BYTE, True), lambda t: plain.encode(t, add_special_tokens=False).ids), (WordIds(BYTE), lambda t: own.encode(t, add_special_tokens=False).ids),
        (FoldedIds(FOLDED), lambda t: folded.encode(t, add_special_tokens=False).ids), (PieceIds(PIECE), pieces.encode),
    ):
        assert cached.by_word
        for lo in range(0, len(texts), 50):
            part = texts[lo : lo + 50]
            assert [np.frombuffer(x, "<u4").tolist() for x in cached.encode(part)] == [want(t) for t in part]


def aligned(texts):
    """Brute force: (n_a, n_b, groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(visible)))}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    for t in texts:
        found = [[(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {t}", add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(t)]] if t else [[], []]
        if any(b"".join(x for _, x in side) != f" {t}".encode() for side in found):
            found = [[], []]
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in found]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [tuple([i for (i, _), e in zip(side, es, strict=True) if lo < e <= hi] for side, es in zip(found, ends, strict=True)) for lo, hi in zip([0, *shared], shared, strict=False)]
        yield len(found[0]), len(found[1]), groups


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 300])
def test_alignment(spark, chunk_bytes):
    texts = odd_texts() + ["the cat sat", "the cat sat", "the dog sat"]
    rows = [(k % 290, t) for k, t in enumerate(texts)] + [(None, "the cat sat")]
    want = [(r[0], *x) for r, x in zip(rows, aligned([t for _, t in rows]), strict=True)]
    count = collections.Counter(p for *_, g in want for p in {(i, j) for x, y in g for i in x for j in y})
    top = collections.defaultdict(int)
    for (i, _), k in count.items():
        top[i] = max(top[i], k)
    expected = []
    for d, n_a, n_b, groups in want:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        expected.append((d, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), said))
    got = token_alignment.alignments(frame(spark, rows).repartition(3), BYTE, PIECE, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    digests = token_alignment.alignments(frame(spark, rows), BYTE, PIECE, digest=True).select("groups").collect()
    assert sorted(r[0] for r in digests) == sorted(hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for x in expected)
    assert token_alignment.alignments(frame(spark, []), BYTE, PIECE).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_shared_cuts(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(token_alignment, "NEAR", seed % 3)
    ends_a, ends_b, firsts, total, want = [], [], ([0], [0]), 0, ([], [])
    for _ in range(rnd.randint(0, 6)):
        n = rnd.choice([0, 1, 2, 9, 60, 400])
        if n:
            a, b = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, n)), n}) for _ in range(2))
            both = set(a) & set(b)
            for side, (ends, own) in enumerate(((ends_a, a), (ends_b, b))):
                want[side].extend(len(ends) + k for k, e in enumerate(own) if e in both)
                ends.extend(total + e for e in own)
            total += n
        firsts[0].append(len(ends_a))
        firsts[1].append(len(ends_b))
    if ends_a:
        got = token_alignment.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(firsts[0]), np.array(firsts[1]))
        assert [x.tolist() for x in got] == list(want)


def test_op11_as_registered(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in token_alignment.op11_token_alignment(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for (d, _), (n_a, n_b, groups) in zip(docs.items(), aligned(docs.values()), strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        r = got[d]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups), sum(len(x) * len(y) for x, y in groups))
        assert r["groups_sha256"] == (hashlib.sha256(said.encode()).hexdigest() if said else "")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(count, ratio=10):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] is not None else None) for w, n in count.items())


@pytest.mark.parametrize("block", [512, 2])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rnd = random.Random(block)
    count = {}
    for _ in range(60):
        base = "".join(rnd.choice("abcé") for _ in range(rnd.choice([1, 2, 3, 7, 8, 9])))
        for _ in range(rnd.randint(1, 8)):
            count[base] = rnd.choice([2, 2, 3, 20, 20, 30, 250, 3000])
            k = rnd.randrange(len(base) + 1)
            base = rnd.choice([base[:k] + rnd.choice("abÿ") + base[k:], base[:k] + rnd.choice("abd") + base[k + 1 :], (base[:k] + base[k + 1 :]) or "z"])
    vocab = spark.createDataFrame([(w, n, 1) for w, n in count.items()], "word string, n long, key int")
    got = spelling.variants(vocab).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute_variants(count)
    assert spelling.variants(vocab.limit(0)).count() == 0


def brute_words(docs, every):
    count = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def test_words(spark):
    rnd = random.Random(1)
    docs = [(k % 40, " ".join(rnd.choice(["Première", "ÉCOLIER×", "straßen÷x", "variants", "Variant", "abcdefgh", "éàü", "x" * 30, "日本語"]) for _ in range(30))) for k in range(60)]
    docs += [(None, "variants variants VARIANTS"), (7, None), (8, ""), (9, "q" * 5000 + " " + "q" * 5000)]
    for every in (2, 31):
        got = spelling.vocabulary(spelling.words(frame(spark, docs), typo_every=every)).collect()
        assert {r["word"]: r["n"] for r in got} == brute_words(docs, every)
    assert spelling.vocabulary(spelling.words(frame(spark, []))).count() == 0


def test_op12_as_registered(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.ORACLE_SQL['op12_spelling_variants']})").fetchall()
    got = spelling.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_open_bins(most):
    """Against a list that is searched for the tightest open bin."""
    rnd = random.Random(most)
    bins, free, opened = packing.OpenBins(50, most), {}, 0
    for _ in range(3000):
        n = rnd.choice([1, 2, rnd.randint(1, 50), 50])
        number, offset = bins.place(n)
        fitting = [f for f in free.values() if f >= n]
        if fitting:
            assert free[number] == min(fitting)
        else:
            assert number == opened
            opened, free[number] = opened + 1, 50
        assert offset == 50 - free[number]
        free[number] -= n
        if not free[number]:
            del free[number]
        elif len(free) > most:
            assert len(free) == most + 1
            free = {b: f for b, f in free.items() if b in dict(bins.rest())}
        assert sorted((b, 50 - f) for b, f in free.items()) == sorted(bins.rest()) and len(free) <= most
        assert bins.bits == sum({1 << f for f in free.values()})


def check_packing(rows, docs, size, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    expected = sorted((str(d), k, k * size, len(x) // 4, zlib.crc32(x)) for d, t in docs for k, x in enumerate(ids(t)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(by_sequence)


def cut_ids(size):
    from tokenizers import Tokenizer

    folded = Tokenizer.from_file(FOLDED)

    def ids(t):
        data = np.array([*folded.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        return [data[k : k + 4 * size] for k in range(0, len(data), 4 * size)]

    return ids


@pytest.mark.parametrize("most", [2, 256])
def test_packed(spark, most):
    docs = [(k % 250, t) for k, t in enumerate(odd_texts())] + [(None, "one"), (None, "two"), (5, "the " * 31), (6, "the " * 63), (6, "the " * 64)]
    rows = packing.packed(frame(spark, docs).repartition(5), FOLDED, size=32, open_bins=most, ids=True).collect()
    n = check_packing(rows, docs, 32, cut_ids(32))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert n <= (1.1 if most > 2 else 1.5) * -(-sum(r["length"] for r in rows) // 32)
    assert packing.packed(frame(spark, []), FOLDED).count() == 0


def test_many_splits_leave_few_half_empty(spark):
    docs = [(k, "a b c") for k in range(400)]
    rows = packing.packed(frame(spark, docs).repartition(40), FOLDED, size=1000).collect()
    assert check_packing(rows, docs, 1000, cut_ids(1000)) == 2


def test_op13_as_registered(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op13_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, docs, 4096, cut_ids(4096))
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1
