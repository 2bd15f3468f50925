"""corpusflow — text-corpus preparation and evaluation analytics on Spark.

Every public operator is a function ``DataFrame -> DataFrame`` built on the
DataFrame / SQL API.  Sub-packages:

* ``functions``  column expressions (strip, tokenise, labels, URLs, arrays, HTML)
* ``operators``  DataFrame operators (dedup, stats, splits, vocab, sequences, ...)
* ``sources``    readers and writers
* ``plans``      composed jobs and the registered query catalogue
* ``streaming``  Structured Streaming operators
"""

from corpusflow.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
