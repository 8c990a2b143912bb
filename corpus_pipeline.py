"""The corpus pipeline: language ID, exact dedup, near dedup, personal data, packing; each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and reads them again as the next one's docs.

Every stage takes an empty table, repeated rows, null ids, texts of any length and columns of any other names, and gives
an empty table, or does to each row what it would do to it alone, but where rows are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import exact_dedup, langid, packing, pii, simhash
from lintlake.llm.common import ready, small_batches, written


def sure(languages: int) -> float:
    """Mean marginal below which no language is taken as certain: a fifteenth of the way from a uniform guess to certainty, so only texts that speak for no language at all fall below. One language is always certain."""
    return 1 / languages + (1 - 1 / languages) / 15 if languages > 1 else 0.0


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too) or without a language that is at least sure() go; the others get the predicted language. Where no row has a language to learn from, all with letters stay as they are. Repeated rows fare alike."""
    small_batches(ready(spark))
    rows = langid.sample(docs)
    model = langid.fit(rows) if rows else None
    predict = langid.predictor(spark.sparkContext.broadcast(model))
    least = sure(len(model.langs)) if model else 0.0
    names, at_text, at_lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score in predict(batches, at_text):
            if model is None:
                yield b.filter(pa.array([bool(langid.words_of(t or "")) for t in b.column(at_text).to_pylist()], pa.bool_()))
                continue
            keep = pa.array([p != langid.UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_())
            cols = [pa.array(pred, pa.string()) if i == at_lang else b.column(i) for i in range(len(names))]
            yield pa.record_batch(cols, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def by_exact_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space; null and empty ones are equal) one row stays: that with most code points, then the smallest id, a null id last; of repeated rows one."""
    small_batches(spark)
    return exact_dedup.keep_one(docs)


def by_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies one document stays, the one with the smallest id (a null id last; of rows that repeat an id one by its text, and rows that repeat both stay together: the stage before has none). Texts without words have one fingerprint and are one component."""
    small_batches(spark)
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become <KIND>, and n_chars follows; a document without any is left as it is, a null text stays null. Rows stay as many as they are."""
    small_batches(ready(spark))
    find = pii.finder(spark.sparkContext.broadcast(pii.fitted(docs)))
    names, at_text = docs.columns, docs.columns.index("text")
    at_chars = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, found in find(batches, at_text):
            clean = [pii.redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[at_text] = pa.array([None if o is None else c for o, c in zip(b.column(at_text).to_pylist(), clean, strict=True)], pa.string())
            if at_chars >= 0:  # the count follows the text where the text has changed
                cols[at_chars] = pa.array([len(c) if spans else n for n, (_, spans), c in zip(b.column(at_chars).to_pylist(), found, clean, strict=True)], b.schema.field(at_chars).type)
            yield pa.record_batch(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: a row for each piece. A null or empty text is the end id alone; repeated rows and rows of null ids are packed like any other."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("exact", by_exact_copy),
    ("near", by_near_copy),
    ("personal", without_personal_data),
    ("packing", packed),
]

#: Fitted models and tokenizers cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
