"""ontocat — ontology-driven catalog tagging on Spark.

The knowledge graph is a plain triples DataFrame (see :mod:`ontocat.model`);
every operator is a function ``DataFrame -> DataFrame`` built from Spark
DataFrame/SQL primitives, so Catalyst does pruning, pushdown and join
selection.
"""

from ontocat.model import TRIPLE_SCHEMA, Vocab  # noqa: F401

__all__ = ["TRIPLE_SCHEMA", "Vocab"]
