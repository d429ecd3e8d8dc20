"""briefkit — Spark-native analytics over corpora of periodic text messages.

Every public operator is a pure ``DataFrame -> DataFrame`` (or
``Column -> Column``) function: no session, clock or file I/O inside an
operator, so Catalyst sees one declarative plan per job.
"""

__version__ = "0.1.0"
