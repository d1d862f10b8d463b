"""unionlake: semantic table-union search over data lakes, as Spark jobs.

Every operator is a DataFrame-in, DataFrame-out function.  Sub-packages:

* ``sources``   – lake scans, list/truth files, corpus files, sinks, fixtures
* ``functions`` – column expressions (text normalisation, n-grams, vectors)
* ``operators`` – cleaning, embedding, LSH, search, evaluation, sampling,
                  contrastive pairs, walks, row linearisation
* ``plans``     – registered end-to-end queries and their DuckDB oracles
* ``streaming`` – query tables arriving as a stream, probed against an index
"""

from unionlake.session import checkpoint_dir, get_spark, prepare  # noqa: F401

__version__ = "0.1.0"
