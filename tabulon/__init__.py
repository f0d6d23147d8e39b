"""tabulon: catalogue tablizing, text features, topic spaces and
neighbourhoods as PySpark DataFrame functions.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built on
public Spark APIs.  Sub-packages:

* ``sources``   – readers / writers (delimited text, XML, JSON, binary files,
  positional logs, long-form matrices, append-only result logs)
* ``functions`` – column-expression helpers (text normalisation, vector math,
  hashing used for deterministic sampling)
* ``operators`` – the operators of the pipeline (tablizing, catalogue tables,
  text features, topic space, pairs and evaluation, neighbourhoods,
  distances, topic profiles)
* ``plans``     – end-to-end compositions and the wiring of the driver tables
* ``streaming`` – incremental (resumable) processing of a landing folder
"""

__version__ = "0.1.0"
