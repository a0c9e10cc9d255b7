"""The shuffle-join paths used above the broadcast bounds give the same results."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

KEYS = ["upsert_tables", "register_inventory", "update_properties", "delete_objects", "import_merge",
        "concept_detail", "concept_summary", "assigned_objects", "entity_by_uri", "trigram_search",
        "list_filter", "tag_mappings", "concepts_alt_labels_bag", "concept_summary_items",
        "tag_changes_from_json", "graph_links"]


@pytest.mark.parametrize("name", KEYS)
def test_shuffle_paths_match_broadcast_paths(spark, monkeypatch, name):
    from ontocat.operators import entities, graphview, joins, mutations, search

    q = E.queries()[name]
    expected = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    for module in (entities, graphview, mutations, search):
        monkeypatch.setattr(module, "broadcast_if_bounded", lambda df: joins.broadcast_if_bounded(df, max_rows=-1))
    got = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    assert got == expected
