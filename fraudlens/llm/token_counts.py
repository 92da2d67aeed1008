"""Exact token counts for every context limit, from one histogram of lengths.

Documents are encoded and aggregated by encoded length (partial sums in every
task, so only distinct lengths are shuffled). Running sums over the lengths then
answer, for each limit: how many documents are longer, how many tokens there are
in all, how many remain when documents are truncated to the limit, and which
length is a quantile.

Defined results: texts have no length limit; other columns, whatever their names, are not read; null and empty texts
have length zero (and count as documents); repeated documents count as often as they occur; an empty table has an
empty histogram. Lengths do not include an end id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.llm.common import bounded_batches, staged
from fraudlens.llm.tokenize import shared_encoder, tokenizer_path

#: Lengths of one block of the running sums: a block is summed in one task.
BLOCK = 256


def token_length(tokenizer: str | None = None):
    """UDF text -> number of ids."""
    path = tokenizer or tokenizer_path()

    @F.pandas_udf(T.LongType())
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = shared_encoder(path)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) // 4 for t in texts], dtype="int64")

    return length


def histogram(docs: DataFrame, text_col: str = "text", id_col: str | None = None,
              tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs[, least_doc_id]): one row a distinct length."""
    bounded_batches(docs.sparkSession)
    lengths = docs.select(token_length(tokenizer)(F.col(text_col)).alias("n_tokens"),
                          *([F.col(id_col).alias("id")] if id_col else []))
    return lengths.groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("n_docs"), *([F.min("id").alias("least_doc_id")] if id_col else []))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length L of a histogram: n_docs_longer and n_tokens_longer (documents
    of more than L tokens, and their tokens), truncated_total (all tokens when
    documents are cut at L), truncated_docs, and the totals of all documents.

    Blocks of lengths are summed first; the sums over blocks and inside a block
    are small windows, so no task sorts the whole histogram."""
    hist = staged(hist, "lengths")
    b = F.floor(F.col("n_tokens") / block).alias("block")
    sums = hist.groupBy(b).agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("toks"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("block", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
                       F.coalesce(F.sum("toks").over(later), F.lit(0)).alias("toks_after"),
                       F.sum("docs").over(everything).alias("total_docs"),
                       F.sum("toks").over(everything).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    longer_docs = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")
    longer_toks = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)) + F.col("toks_after")
    return (hist.withColumn("block", F.floor(F.col("n_tokens") / block)).join(sums, "block")
            .withColumn("n_docs_longer", longer_docs).withColumn("n_tokens_longer", longer_toks)
            .withColumn("truncated_total", F.col("total_tokens") - F.col("n_tokens_longer")
                        + F.col("n_docs_longer") * F.col("n_tokens"))
            .drop("block", "docs_after", "toks_after"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """(q, n_tokens): the least length that at least a share q of the documents does not exceed."""
    at_most = F.col("total_docs") - F.col("n_docs_longer")
    return sums.agg(*[F.min(F.when(at_most >= F.ceil(F.lit(q) * F.col("total_docs")), F.col("n_tokens"))).alias(str(i))
                      for i, q in enumerate(probabilities)]).select(F.explode(F.array(*[
                          F.struct(F.lit(q).alias("q"), F.col(str(i)).alias("n_tokens"))
                          for i, q in enumerate(probabilities)])).alias("r")).select("r.*")


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row (tokens): all tokens when documents are cut at ``limit``, for any limit.

    Documents longer than the limit are those longer than the greatest length up to it."""
    r = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "n_docs_longer", "n_tokens_longer")))
    return sums.agg(r.alias("r"), F.max("total_docs").alias("d"), F.max("total_tokens").alias("t")).select(
        F.coalesce(F.col("t") - F.coalesce(F.col("r.n_tokens_longer"), F.col("t"))
                   + limit * F.coalesce(F.col("r.n_docs_longer"), F.col("d")), F.lit(0)).alias("tokens"))


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The histogram of ``docs`` with its suffix sums."""
    return suffix_sums(histogram(docs.select("doc_id", "text"), id_col="doc_id", tokenizer=tokenizer)).select(
        "n_tokens", "n_docs", "least_doc_id", "n_docs_longer", "n_tokens_longer", "truncated_total", "total_docs",
        "total_tokens")
