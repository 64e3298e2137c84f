"""assaylake: Spark-native operators for sparse, repeated assay tables.

Sub-packages
------------
functions  Column-level helpers (numeric edges, formatting, hashing, text).
sources    Readers and writers (TSV/parquet/JSON lines, folds, unions).
operators  Table operators (keys, consensus, splits, profiles, fingerprints,
           similarity, retrieval, prompts, answers, metrics, UDF hooks).
plans      Proxy tables over the driver's test data and the registered queries.
streaming  Row-local operators applied to Structured Streaming sources.
"""

__version__ = "0.1.0"
