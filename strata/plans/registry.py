"""All registered queries outside the optional subpackage, with their SQL."""

from strata.plans import graphs, hybrids, stores, texts, training, vectors

_MODULES = (vectors, texts, graphs, hybrids, stores, training)

FLAGSHIP = "hybrid_graph_rank"
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
