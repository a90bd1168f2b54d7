"""Knowledge-graph retrieval over documents, expressed as Spark DataFrames.

The four public verbs are ``ingest`` (documents to knowledge tables), ``save``
(knowledge tables to a store), ``link`` (equal names across documents) and
``answer`` (questions to answers with evidence).
"""

import sys

from pyspark import cloudpickle

from quiltgraph.config import Settings

# Functions sent to executors travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings", "ingest", "save", "link", "answer"]


def __getattr__(name):
    if name == "ingest":
        from quiltgraph.plans.ingest import ingest as verb
    elif name == "save":
        from quiltgraph.plans.ingest import save as verb
    elif name == "link":
        from quiltgraph.plans.link import link as verb
    elif name == "answer":
        from quiltgraph.plans.answer import answer as verb
    else:
        raise AttributeError(name)
    return verb
