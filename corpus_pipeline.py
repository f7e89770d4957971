"""From raw documents to token files: five stages, each over all that the one before kept.

``run`` writes every stage's rows into the shared folder and reads them again for the next, so a lost
executor costs at most one stage's tasks, and deletes a stage's rows and all tables of its operators once the next
rows are written. SQL has no support vector machines, so there is no SQL for the
whole run (``ORACLE_SQL`` is None); tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import contamination, language, mixing, ngram_join, token_files
from tidewater.llm.common import checkpointed, crc_mod, drop_stored, shared_dir, stage_tables, stored

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. Where ``lang`` is null, the
    predicted one takes its place. If no row has a usable text and language, none can be learned or filled in,
    and the same documents go."""
    model = language.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model).filter("lang_pred <> 'und'")
    return found.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates; of rows that share an id,
    the one with the smallest hash of its columns, whatever the partitions. Rows without an id are in no class
    and stay."""
    found = checkpointed(ngram_join.near_duplicates(docs, count_links=False).select("doc_id", "component_id"))
    kept = ngram_join.only(docs, found.filter("doc_id <> component_id").select("doc_id").distinct(), "left_anti")
    repeated = checkpointed(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    first = ngram_join.only(kept, repeated, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return ngram_join.only(kept, repeated, "left_anti").unionByName(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item; rows without an id or that share one are judged
    each by its own text."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target: documents below its threshold once more than the others, repeats
    as repeated rows; rows equal in id and text are taken together."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32; no documents give no rows.
    The files are the pipeline's product and stay."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path, ids=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with stage_tables(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", folder=shared_dir(spark))
        if before is not None:
            drop_stored(before)
        before = docs
    with stage_tables(spark):
        found = STAGES[-1][1](spark, docs, sf_dir)  # has written its files by now
    drop_stored(docs)
    return found
