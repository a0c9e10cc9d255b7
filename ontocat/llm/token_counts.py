"""Exact token counts: a histogram of encoded lengths with suffix sums."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's ``\\s`` sees it, in runs that are cut out before the pattern is applied.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: Lengths per block of the two-level suffix sums.
BLOCK = 1024

_ENCODERS: dict[int, tiktoken.Encoding] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file (a base64 token and its rank per line), built once per worker."""
    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def n_tokens(encoding: tiktoken.Encoding, text: str) -> int:
    """The number of tokens of a whole text.

    The pattern's look-ahead after white space keeps a state per blank and fails
    on a million of them in a row. Long runs are therefore encoded by
    themselves, as the one piece that the pattern makes of them: all blanks, or
    all but the last if text follows, which that text's piece may begin with.
    The pattern looks at nothing before a piece, so the rest is unchanged.
    """
    if encoding._pat_str != PATTERN:
        return len(encoding.encode_ordinary(text))
    n = start = 0
    for run in LONG_BLANK.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[start:run.start()])) + blank_tokens(encoding, text[run.start():stop])
        start = stop
    return n + len(encoding.encode_ordinary(text[start:]))


def blank_tokens(encoding: tiktoken.Encoding, blanks: str) -> int:
    return len(encoding._core_bpe.encode_single_piece(blanks.encode()))


def _counter(shared, pattern: str):
    @arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = encoder(shared.value, pattern)
        for chunk in texts:
            yield pa.array([n_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in chunk], pa.int64())
    return count


def token_length(docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text") -> Column:
    """The number of tokens of a whole text as a column; 0 for null and empty texts.

    The rank file (about 1 MB) is read by the driver and broadcast, so
    executors need no copy of it.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return _counter(shared, pattern)(F.col(text))


def length_histogram(docs: DataFrame, **options) -> DataFrame:
    """``(n_tokens, n_docs)``: how many documents have each encoded length.

    Counts are added up in the tasks first, so equal lengths, hot sources and
    groups of copies cost nothing extra. Null and empty texts have length 0;
    no documents give no rows.
    """
    return (docs.select(token_length(docs, **options).alias("n_tokens")).groupBy("n_tokens")
            .agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length L what a context limit of L means for the corpus.

    ``docs_longer`` and ``tokens_longer``: documents of more than L tokens and
    their tokens; ``truncated_total``: tokens left when every document is cut
    at L; ``docs_upto``: documents that fit, which is the rank that quantiles
    look up. Sums run in two levels, so no task orders all lengths: within
    blocks of 1,024 lengths, and over the block totals, of which there are at
    most the longest length / 1,024.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
                           F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("d").over(everything).alias("docs_all"),
                           F.sum("t").over(everything).alias("tokens_all"))
    inside = (Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    tokens = F.col("n_docs") * F.col("n_tokens")
    longer = (rows.withColumn("d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
              .withColumn("t", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
              .join(blocks, "block")
              .withColumn("docs_longer", F.col("docs_above") + F.col("d"))
              .withColumn("tokens_longer", F.col("tokens_above") + F.col("t")))
    return longer.select("n_tokens", "n_docs", "docs_longer", "tokens_longer",
                         (F.col("docs_all") - F.col("docs_longer")).alias("docs_upto"),
                         (F.col("tokens_all") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"))


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Tokens left at any ``limits (context)``, also at lengths that no document has.

    Between two lengths the total grows by one token per longer document, so
    the nearest length at or below the limit answers: its total plus
    ``docs_longer`` times the difference. Below the shortest length every
    document is cut: ``context`` times all documents.
    """
    first = sums.agg(F.max(F.col("docs_longer") + F.col("docs_upto")).alias("docs"))
    at = (limits.select("context").join(sums, F.col("n_tokens") <= F.col("context"), "left").groupBy("context")
          .agg(F.max_by(F.struct("n_tokens", "docs_longer", "truncated_total"), "n_tokens").alias("s")))
    return at.join(F.broadcast(first)).select("context", F.coalesce(
        F.col("s.truncated_total") + F.col("s.docs_longer") * (F.col("context") - F.col("s.n_tokens")),
        F.col("context") * F.col("docs"), F.lit(0)).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the least length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    docs = F.col("docs_longer") + F.col("docs_upto")
    return (sums.select("*", asked).filter(F.col("docs_upto") >= F.greatest(F.ceil(F.col("share") * docs), F.lit(1)))
            .groupBy("share").agg(F.min("n_tokens").alias("n_tokens")))
