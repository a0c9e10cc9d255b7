"""Small inputs that every operator has to cope with, and plain versions to compare with."""

from __future__ import annotations

import random
import re

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns named like what the operators use inside.
CLASHING = ["size", "shard", "slot", "key", "hash", "score", "match", "token", "_key", "_plan", "_rank", "_part", "_start",
            "_hash", "_id", "placed", "mixed", "deduped", "n", "row", "best"]
LONG = "lorem ipsum " * 60_000


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_docs(spark, clashing=True):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies, other scripts."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base, "en", "b", 1), (2, base, "en", "b", 1), (3, " ".join(near), "en", "a", 1), (3, " ".join(near), "en", "a", 1),
            (4, "", "en", "a", 0), (5, None, None, None, None), (6, " \n\t ", "en", "a", 3), (None, base, "en", "b", 1),
            (None, None, None, None, None), (7, "one", "en", "c", 3), (8, "one two", "de", "c", 3), (9, "ONE two", "de", "c", 3),
            (10, LONG, "en", "a", len(LONG)), (11, "x" * 300_000, "en", None, 1), (12, "\u0130stanbul \u00c9T\u00c9 \U0001f600 \x00 end", "fr", "\U0001f600", 2)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 80)), "en", f"s{i % 4}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    if clashing:
        for name in CLASHING:
            docs = docs.selectExpr("*", f"'kept' as `{name}`")
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def values(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)
