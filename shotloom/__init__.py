"""shotloom: few-shot example retrieval and prompt-corpus jobs on Spark.

Every public operator is a function ``DataFrame(s) -> DataFrame``; the query
registry in :mod:`shotloom.plans.registry` wires them to the driver tables.
"""

__version__ = "0.1.0"
