"""snapshot_log and what else reads tables: a scan's task reads 16 MB of files, unless the session has a size of its own."""

import pytest

from ontocat.session import RECOMMENDED_CONF, SPLIT_BYTES, bound_tasks

KEY, COST = SPLIT_BYTES


@pytest.fixture
def own(spark):
    old = {k: spark.conf.getAll.get(k) for k in SPLIT_BYTES}
    for k in SPLIT_BYTES:
        spark.conf.unset(k)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_files_are_split_by_16_mb_unless_the_session_has_its_own_size(own):
    assert {k: RECOMMENDED_CONF[k] for k in SPLIT_BYTES} == SPLIT_BYTES
    bound_tasks(own)
    assert {k: own.conf.get(k) for k in SPLIT_BYTES} == SPLIT_BYTES
    own.conf.set(KEY, "4m")
    own.conf.set(COST, "1m")
    bound_tasks(own)
    assert (own.conf.get(KEY), own.conf.get(COST)) == ("4m", "1m")
