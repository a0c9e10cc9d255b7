import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ontocat.session import local_session

    s = local_session("*", shuffle_partitions=8, app="ontocat-tests")
    # Tests run locally: a private scratch folder stands in for the shared one.
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ontocat-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def graph_small(spark):
    from ontocat.plans import inputs

    return inputs.graph(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tags_small(spark):
    from ontocat.plans import inputs

    return inputs.current_tags(spark, SF_SMALL)


def make_graph(spark, rows):
    """Triples from tuples ``(s, p, o[, kind[, datatype[, lang]]])``; kind defaults to iri."""
    from ontocat.model import TRIPLE_SCHEMA

    full = []
    for r in rows:
        s, p, o = r[:3]
        kind = r[3] if len(r) > 3 else "iri"
        dt = r[4] if len(r) > 4 else None
        lang = r[5] if len(r) > 5 else None
        full.append((s, p, o, kind, dt, lang))
    return spark.createDataFrame(full, TRIPLE_SCHEMA).distinct()
