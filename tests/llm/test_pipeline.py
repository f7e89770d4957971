"""The corpus pipeline stage by stage against brute force, on a small fixture."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import mixing
from tidewater.llm.common import stored

from test_corpus import classes, speak  # noqa: I001  pytest puts this folder on the path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    d = tmp_path_factory.mktemp("corpus")
    item = speak("en", rnd, 25)
    rows = [(k, speak(lang := ("en", "de", "fr", "es")[k % 4], rnd, rnd.randint(5, 80)), lang, f"s{k % 3}", 0) for k in range(160)]
    rows += [(200 + k, rows[k][1] + (" end" if k % 2 else ""), rows[k][2], "s1", 0) for k in range(20)]
    rows += [(300, "12 34", None, None, 0), (301, None, "en", "s2", 0), (302, f"{speak('en', rnd, 9)} {item} {speak('en', rnd, 9)}", "en", "s2", 0)]
    # columns in another order, and more of them, with names that operators use themselves
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("1 AS copies", "text", "2 AS threshold", "lang", "doc_id", "source", "n_chars", "'x' AS tokens")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows


def test_stages(spark, corpus):
    d, rows = corpus
    docs, kept, columns = spark.read.parquet(f"{d}/documents.parquet"), {r[0]: r for r in rows}, None
    columns = docs.columns
    want = {r[0] for r in rows} - {300, 301}
    for name, stage in corpus_pipeline.STAGES[:3]:
        if name == "near_duplicates":
            found = classes([(k, kept[k][1]) for k in sorted(want)])
            want = {k for k in want if found[k][1] == k}
        if name == "decontamination":
            want -= {302}
        docs = stored(stage(spark, docs, d), name)
        assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(want), name
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    docs = stored(corpus_pipeline.STAGES[3][1](spark, docs, d), "mix")
    taken = sorted(r["doc_id"] for r in docs.collect())
    assert docs.columns == columns and taken == sorted(k for k, n in times.items() for _ in range(n))
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start, files = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for k in taken:
        ids = np.array([*t.encode(kept[k][1], add_special_tokens=False).ids, 0], "<u4")
        files.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.STAGES[4][1](spark, docs, d)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == files
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == files


def test_language_is_filled_in(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang")
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, d).collect()}
    assert sum(found[r[0]] == r[2] for r in rows if r[0] in found) >= len(found) - 3 and None not in found.values()
    unknown = corpus_pipeline.identify_language(spark, docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"), d)
    assert {r["doc_id"] for r in unknown.collect()} == set(found)


def test_repeated_ids_keep_a_stable_row(spark, corpus):
    d, _ = corpus
    rows = [(5, "first text of the two it is"), (5, "second text of the two here"), (5, "first text of the two it is"), (None, "some words"), (None, "some words"), (6, None)]
    kept = [{tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(x, "doc_id long, text string").repartition(n), d).collect()} for x, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1] and len([r for r in kept[0] if r[0] == 5]) == 1


def test_empty_corpus(spark, corpus, tmp_path):
    d, _ = corpus
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_judges_each_row(spark, corpus):
    d, _ = corpus
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    rows = [(None, f"some words {item} and more"), (None, "clean"), (5, f"{item}"), (5, "clean too"), (6, None), (7, "")]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), d).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[k] for k in (1, 3, 4, 5)]))


def test_no_stage_tables_are_left(spark, tmp_path, monkeypatch):
    """Only the product stays: token files, and what the session's own cleaner takes (checkpoints)."""
    monkeypatch.setattr("tidewater.llm.common.shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["pipeline", "tokens"]]
