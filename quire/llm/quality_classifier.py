"""Quality classifier: a Kneser-Ney model of trusted text gives every document a perplexity; its language's quantile decides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import forget, small_side, written

#: Rows of trusted ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def classify_quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, slack: float = 2.0, **model) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, lang, n_words, loss, limit, kept, row (a hash of id, language and text).

    `trusted` (doc_id) names the documents whose whole texts train the model. Every document, trusted or not, is scored
    by the half of the trusted texts that it isn't in. A document goes if its perplexity is over `slack` times the
    `quantile` of the trusted documents of its language.

    Null or empty text: no words, null loss, kept false. Null lang: a language of its own, ''. A language without
    trusted documents has no limit: its documents stay. Null doc_id: scored, never trusted. Repeated rows: a row each.
    Columns besides doc_id, text and lang are ignored, whatever their names. Empty tables give an empty result. `model`:
    see `document_scores`.
    """
    ids = trusted.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct().withColumn("used", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "text").join(small_side(ids, BROADCAST_IDS), "doc_id", "left")
    losses = kn.document_scores(rows, F.coalesce("used", F.lit(False)), trained=True, **model)
    scored = written(losses, "quality")
    forget(*losses._uses)
    found = kn.quantiles(scored.filter("trained"), {"at": quantile})
    out = kn.with_limits(scored, {lang: {"limit": x["at"] + math.log(slack)} for lang, x in found.items()}, "limit")
    return out.select("doc_id", "lang", "n_words", "loss", "limit", F.expr("loss is not null and (limit is null or loss <= limit)").alias("kept"), "row")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as of good quality and not as toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
