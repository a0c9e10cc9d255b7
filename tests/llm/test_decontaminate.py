import random

from pyspark.sql import functions as F

from ontocat.llm import decontaminate as D

from .helpers import empty_docs, messy_docs, sentence

ITEMS = "item_id bigint, text string"


def brute(text, items, window=10):
    """Word count, hit words and items by trying every window at every place."""
    words, hit, found = D.words_of(text), set(), set()
    for item, body in items:
        parts = D.words_of(body)
        size = min(window, len(parts))
        for s in range(len(parts) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == parts[s:s + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), found


def test_index_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        items = [(str(i), sentence(rng, rng.randrange(0, 16), 4).encode()) for i in range(4)]
        text = sentence(rng, rng.randrange(0, 60), 4).encode()
        n, spans, found = D.Index(items, 10).match(text)
        assert (n, sum(k for _, k in spans), found) == brute(text, items)
        assert all(a + k < b for (a, k), (b, _) in zip(spans, spans[1:]))


def test_words_lower_only_ascii():
    assert D.words_of("Caf\u00c9 A-b_1\u2003x".encode()) == ["caf\u00c9".encode(), b"a", b"b", "1\u2003x".encode()]
    assert D.words_of(None) == [] == D.words_of(b"")


def test_blocks_agree_with_one_block(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, 14, 5)) for i in range(20)] + [(None, "w1"), (50, None), (51, ""), (3, sentence(rng, 3, 5))]
    bench = spark.createDataFrame(items, ITEMS)
    docs = spark.createDataFrame([(i, sentence(rng, 200, 5)) for i in range(20)] + [(99, None), (98, "")], "doc_id bigint, text string")
    one = D.find_contamination(docs, bench).select("doc_id", "match.*")
    many = D.find_contamination(docs, bench, block_bytes=150).select("doc_id", "match.*")
    want = sorted(map(tuple, one.collect()))
    assert want == sorted(map(tuple, many.collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:  # several groups of several batches in a task: tables come and go in both directions
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        groups = D.find_contamination(docs.coalesce(1), bench, block_bytes=150, group_bytes=3_000).select("doc_id", "match.*")
        assert want == sorted(map(tuple, groups.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    own = [(str(i), (t or "").encode()) for i, t in items if i is not None]
    tried = [brute((r.text or "").encode(), own) for r in docs.orderBy("doc_id").collect()]
    assert [(n, k, sorted(found)) for n, k, found in tried] == [(r.n_words, sum(s["length"] for s in r.spans), r["items"]) for r in one.orderBy("doc_id").collect()]


def test_messy_rows_keep_columns(spark):
    docs = messy_docs(spark)
    bench = spark.createDataFrame([(1, "one two"), (2, "lorem IPSUM"), (2, "lorem IPSUM"), (None, "one"), (3, None)], ITEMS)
    found = D.find_contamination(docs, bench, out="hits")
    rows = {r.doc_id: r for r in found.select("doc_id", "hits.*", D.n_hit(F.col("hits")).alias("hit"), "size").collect()}
    assert found.count() == docs.count() and rows[8]["items"] == ["1"] and rows[9].hit == 2 and rows[7]["items"] == []
    assert rows[10].hit == 120_000 and rows[5].n_words == 0 and rows[8]["size"] == "kept"
    clean = D.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 3


def test_empty_tables(spark):
    docs, none = messy_docs(spark), spark.createDataFrame([], ITEMS)
    assert D.clean_documents(docs, none).count() == docs.count()
    assert D.find_contamination(empty_docs(spark), none).count() == 0
