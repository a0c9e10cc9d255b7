import random
import zlib
from itertools import combinations

from ontocat.llm import sharding as S

from .helpers import CLASHING, empty_docs, messy_docs


def best(sizes, shards):
    """Least possible largest shard by trying all cuts."""
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, n)))
               for k in range(shards) for cuts in combinations(range(1, n), min(k, n - 1)))


def test_capacity_is_least_and_cuts_keep_it():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 9, 30]) for _ in range(rng.randrange(1, 10))]
        shards = rng.randrange(1, 5)
        capacity = S.least_capacity(sizes, shards)
        assert capacity == best(sizes, shards)
        ends = S.cut_points(sizes, shards)
        assert len(ends) == shards and ends[-1] == len(sizes) and ends == sorted(ends)
        assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) <= capacity


def test_one_large_group_leaves_the_rest_even():
    sizes = [10] * 300 + [2000] + [10] * 300
    ends = S.cut_points(sizes, 10)
    sums = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
    assert max(sums) == 2000 and sorted(sums)[-2] <= 800 and min(sums) >= 500


def test_shards_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = S.shard_documents(docs).select("doc_id", "text", "placed.*").toPandas()
    assert len(placed) == docs.count()
    for _, rows in placed.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert (placed.groupby("text").shard.nunique() == 1).all()
    assert all(zlib.crc32(t.encode()) == c and len(t.encode()) + 16 == s
               for t, c, s in zip(placed.text, placed.text_crc32, placed["size"]))
    sums = placed.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() < 1.1 * sums.mean()
    again = S.shard_documents(docs.repartition(7)).select("doc_id", "placed.shard", "placed.slot").toPandas()
    both = placed[["doc_id", "shard", "slot"]].sort_values("doc_id").reset_index(drop=True)
    assert both.equals(again.sort_values("doc_id").reset_index(drop=True))


def test_messy_and_empty(spark):
    docs = messy_docs(spark)
    placed = S.shard_documents(docs, shards=3, out="where")
    rows = placed.select("doc_id", "text", "where.*", *[f"`{c}` as" for c in ()]).collect()
    assert len(rows) == docs.count() and set(CLASHING) <= set(placed.columns)
    assert all(r["size"] == 16 and r.text_crc32 is None for r in rows if r.text is None)
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert S.shard_documents(empty_docs(spark)).count() == 0


def test_main_path_is_native(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    S.shard_documents(docs.select("doc_id", "text")).select("doc_id", "placed.*").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
