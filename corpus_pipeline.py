"""A training corpus from `documents`: quality classifier, quality rules, line dedup, n-gram Jaccard join, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor left; all but the last return the
columns of documents. Rows with the same doc_id are one document. A null doc_id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import forget, load, small_side, written
from quire.llm.jaccard_join import jaccard_join
from quire.llm.kneser_ney import row_key
from quire.llm.line_dedup import dedup_lines
from quire.llm.packing import best_fit_packing
from quire.llm.quality_classifier import classify_quality, trusted_ids
from quire.llm.quality_rules import apply_rules

#: Keys of rows that go, which are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of `docs` but those that `judged` (row, kept) rejects."""
    gone = small_side(written(judged.filter("not kept").select(F.col("row").alias("_gone")).distinct(), "rejected"), BROADCAST_KEYS)
    return docs.join(gone, row_key(docs["doc_id"], docs["lang"], docs["text"]) == F.col("_gone"), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of the trusted ones is within their language's limit.

    Texts that are null or hold no word go. A null language is one of its own; a language without trusted documents stays
    whole. A null doc_id is never trusted. Repeated rows share a verdict. Other columns don't matter. Empty: empty.
    """
    return without(docs, classify_quality(docs, trusted_ids(load(spark, sf_dir, "labels"))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and lie in their language's band of perplexity under the model of the plain ones that are left.

    Texts that are null or short go. A language without plain documents has no band. Repeated rows share a verdict, and
    don't fail each other. Other columns don't matter. Empty: empty.
    """
    return without(docs, apply_rules(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id holds; n_chars follows.

    A null text stays null, with its n_chars. A null doc_id keeps its lines and takes none from others. Rows with the same
    doc_id are one document, which keeps its lines in all of them. All columns are carried. Empty: empty.
    """
    out = dedup_lines(docs, carry=True)
    lost = F.col("original.text").isNotNull()
    new = {"text": F.when(lost, F.col("kept_text")), "n_chars": F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col("original.n_chars"))}
    return out.select(*[new.get(c, F.col(f"original.`{c}`")).alias(c) for c in docs.columns])


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles with a similarity of 0.8 link.

    Texts without words link with nothing and stay, as do rows with a null doc_id. Rows with the same doc_id stay or go
    together. Other columns don't matter. Empty: empty.
    """
    found = jaccard_join(docs.select("doc_id", "text"), width=5, percent=80)
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    return docs.join(small_side(gone, BROADCAST_KEYS), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of all that is left. A null or empty text is id 0 alone; repeated rows are packed each. Empty: empty."""
    return best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard),
    ("best-fit packing", packing),
]

#: Perplexity models, shingle groups and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of `documents`."""
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
