"""castlens — credit-graph analytics (people × titles × roles) on PySpark.

Every operator is a plain function ``DataFrame(s) + parameters -> DataFrame``
built from Spark's DataFrame API so Catalyst plans it and the work is spread
over the cluster. Subpackages:

* ``sources``   – readers and writers (delimited, JSON, text, Parquet staging)
* ``functions`` – column-level helpers (keys, positional splits, tokens)
* ``operators`` – ratings, graph (cast lists, BFS), shaping, text, partitions
* ``plans``     – the named queries over the driver tables and their SQL oracles
* ``streaming`` – incremental landing-directory ingest
"""

from castlens.session import build_session, checkpoint_dir, scratch_path

__all__ = ["build_session", "checkpoint_dir", "scratch_path"]
