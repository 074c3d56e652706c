"""Payment-fraud decision analytics expressed as Spark DataFrame jobs.

Subpackages:

* ``sources``   – table readers, the transaction fixture, replay, stream sources and sinks
* ``functions`` – column expressions (time, geometry, contract predicates, display, shard)
* ``operators`` – table-level operators (encoders, sampling, metrics, dashboard, trace, model)
* ``plans``     – named queries over the driver tables and their SQL twins
* ``streaming`` – Structured Streaming scoring job and stream aggregates
"""

__version__ = "0.1.0"
