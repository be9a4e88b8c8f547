"""Operator 9: exact token-length histogram of a corpus.

Documents are encoded once; all that is kept of them is the number of
documents of each encoded length. Suffix sums over that histogram answer, for
every context limit, how many documents exceed it, how many tokens a corpus
truncated to it holds, and the quantile the limit stands at.

Null and empty texts have length 0 and are counted. An empty table gives an
empty histogram. Repeated rows count as often as they occur. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from arrears.session import pin

from .common import table, text_or_empty

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: fixed value: how the byte-pair vocabulary splits a text before merging
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: histogram lengths per block of the two-level suffix sums
BLOCK = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file: one ``base64 rank`` pair a line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with a column ``n_tokens``: the exact encoded length of each
    whole text. The vocabulary is read once on the driver and broadcast; its
    size is that of the file."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or f"{TOKENIZERS}/{VOCABULARY}"))

    @F.pandas_udf(T.LongType())
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks.value,
                                   special_tokens={}).encode_ordinary
        for part in parts:
            yield pd.Series([len(encode(t)) for t in part], dtype="int64")

    return docs.withColumn("n_tokens", lengths(text_or_empty(text)))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, n_docs)``: map-side combined, so what is shuffled is one
    row for each task and distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """What each context limit (each length that occurs) does to the corpus.

    ``n_docs`` documents have exactly ``n_tokens`` tokens, ``docs_over`` have
    more, ``quantile`` is the share with at most as many, ``total_tokens`` is
    the corpus total and ``truncated_tokens`` the total when every document
    is cut to ``n_tokens``. For a limit between two lengths, the row of the
    next smaller length gives ``docs_over``.

    Two levels of sums: inside blocks of lengths in parallel, and over the
    block totals, of which there are max length / BLOCK.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    own = h.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("block")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(everything).alias("all_docs"),
        F.sum("b_tokens").over(everything).alias("all_tokens"))
    upto = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    return (own.join(blocks, "block")
            .withColumn("docs_upto", F.col("docs_before") + F.sum("n_docs").over(upto))
            .withColumn("tokens_upto", F.col("tokens_before") + F.sum("tokens").over(upto))
            .select("n_tokens", "n_docs",
                    (F.col("all_docs") - F.col("docs_upto")).alias("docs_over"),
                    F.col("all_tokens").alias("total_tokens"),
                    (F.col("tokens_upto") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_upto")))
                    .alias("truncated_tokens"),
                    (F.col("docs_upto") / F.col("all_docs")).alias("quantile")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    # used twice, for the rows and for the totals of blocks: written once
    return limits(pin(length_histogram(encoded_lengths(docs).select("n_tokens")), "tokens"))
