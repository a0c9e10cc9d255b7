import corpus_pipeline as P
from ontocat.llm import decontaminate, quality

from .helpers import empty_docs, messy_docs
from .test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_stages_follow_the_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, frames = {r.doc_id: r.text for r in docs.collect()}, docs
    for at, (_, stage) in enumerate(P.STAGES):
        done = stage(spark, frames, SF).cache()
        rows = [(r.doc_id, r.text) for r in done.collect()]
        if at < 4:
            assert done.columns == docs.columns
        assert all(before[i] == t for i, t in rows)
        ids = {i for i, _ in rows}
        if at == 0:
            scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert ids == {i for i, s in scores.items() if s >= 0.5}
        if at == 1:
            want = brute(sorted(before.items()), P.NGRAM, *P.SIMILARITY)
            assert ids == {i for i, _, least in want if i == least} and len(rows) == len(ids)
        if at == 2:
            items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = decontaminate.Index(items, 10)
            assert ids == {i for i, t in before.items() if not index.match(t.encode())[2]}
        if at == 3:
            assert max(sum(1 for i, _ in rows if i == d) for d in list(ids)[:50]) <= 2
            total = sum(len(t.split()) for t in before.values())
            assert abs(sum(len(t.split()) for _, t in rows) - 1.5 * total) <= 30
        if at == 4:
            assert len(rows) == frames.count() and done.select("shard", "slot").distinct().count() == len(rows)
        before, frames = dict(rows), done


def test_messy_documents(spark):
    docs = messy_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", "key", "_rank", "size")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, empty_docs(spark), SF).count() == 0
