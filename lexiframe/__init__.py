"""lexiframe: a Spark-native engine for preparing and evaluating labelled text corpora.

Everything is a ``Column -> Column`` function (``lexiframe.functions``) or a
``DataFrame -> DataFrame`` operator (``lexiframe.operators``); sources and sinks
live in ``lexiframe.sources``, streaming entry points in ``lexiframe.streaming``
and the registered query plans in ``lexiframe.plans``.
"""

__version__ = "0.1.0"
