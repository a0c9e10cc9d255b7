"""The sync plan equals a plain per-entity restatement of the rule on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ontocat.operators import tagsync

NAMES = st.sampled_from(["a", "b", "c", "d"])
TYPES = st.sampled_from(["tables", "columns"])
TAGS = st.sampled_from(["X", "Y", "Z", "W"])
KEYS = st.sampled_from(["TYPE_X", "TYPE_Y", "TYPE_Q", "TYPEX", "BRAND_1", "OTHER"])


def expected_plan(mapping, current, prefix, limit):
    out = set()
    desired = {}
    for t, n, tag in mapping:
        desired.setdefault((t, n), []).append(tag)
    for (t, n), tags in desired.items():
        new = {prefix + tag for tag in tags}
        cur = [k for (ct, cn, k) in current if (ct, cn) == (t, n)]
        old = {k for k in cur if k.startswith(prefix)}
        add, rm = new - old, old - new
        skipped = len(cur) + len(add) - len(rm) >= limit
        out |= {(t, n, k, "add", skipped) for k in add} | {(t, n, k, "delete", skipped) for k in rm}
    return out


@settings(max_examples=12, deadline=None)
@given(
    mapping=st.lists(st.tuples(TYPES, NAMES, TAGS), max_size=12),
    current=st.sets(st.tuples(TYPES, NAMES, KEYS), max_size=16),
    limit=st.integers(min_value=1, max_value=6),
)
def test_plan_matches_restatement(spark, mapping, current, limit):
    m = spark.createDataFrame(mapping, "type string, name string, tag string")
    c = spark.createDataFrame(sorted(current), "entity_type string, entity_name string, tag_key string")
    got = {tuple(r) for r in tagsync.tag_sync_plan(m, c, prefix="TYPE_", limit=limit).collect()}
    assert got == expected_plan(mapping, sorted(current), "TYPE_", limit)
