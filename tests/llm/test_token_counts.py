import random
import re

import numpy as np

from ontocat.llm import token_counts as T

from .helpers import empty_docs, messy_docs


def plain(texts):
    with open(T.VOCABULARY, "rb") as f:
        encode = T.encoder(f.read()).encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts])


def check(docs):
    lengths = plain([r.text for r in docs.select("text").collect()])
    sums = T.suffix_sums(T.length_histogram(docs)).cache()
    rows = sums.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {int(v): int((lengths == v).sum()) for v in set(lengths)}
    for r in rows:
        longer = lengths[lengths > r.n_tokens]
        assert (r.docs_longer, r.tokens_longer, r.docs_upto) == (len(longer), longer.sum(), len(lengths) - len(longer))
        assert r.truncated_total == np.minimum(lengths, r.n_tokens).sum()
    return lengths, sums


def test_every_length(spark):
    lengths, sums = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    limits = [0, 1, 5, 100, 511, 512, 2048, 10 ** 6]
    asked = spark.createDataFrame([(x,) for x in limits], "context bigint")
    assert {r.context: r.truncated_total for r in T.truncated_totals(sums, asked).collect()} == {x: np.minimum(lengths, x).sum() for x in limits}
    ordered = np.sort(lengths)
    for r in T.quantiles(sums, [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == ordered[max(0, int(np.ceil(r.share * len(ordered))) - 1)]


def test_messy_and_empty(spark):
    check(messy_docs(spark))
    assert T.suffix_sums(T.length_histogram(empty_docs(spark))).count() == 0


def test_long_white_space_is_counted_like_short(monkeypatch):
    """Runs cut out of a text give the counts of the plain encoder wherever that one survives."""
    with open(T.VOCABULARY, "rb") as f:
        encoding = T.encoder(f.read())
    monkeypatch.setattr(T, "LONG_BLANK", re.compile(T.LONG_BLANK.pattern.replace("4096", "3")))
    rng = random.Random(3)
    for _ in range(2_000):
        text = "".join(rng.choice(["a", "b1", " ", "'s", "!", "\x1c", "\u00e9", rng.choice(" \t\n\r\x0b\x85\xa0\u3000") * rng.randrange(1, 7)])
                       for _ in range(rng.randrange(12)))
        assert T.n_tokens(encoding, text) == len(encoding.encode_ordinary(text)), text


def test_millions_of_blanks(spark):
    texts = ["a" + " " * 1_000_000 + "x", "\n" * 2_000_000, "\t \n" * 500_000 + "x", " " * 5_000_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lengths = sorted(r[0] for r in docs.select(T.token_length(docs)).collect())
    assert len(lengths) == 4 and lengths[0] >= 1_000_000
