"""loam: a PySpark-native engine for agent-memory corpora (documents, facts, graphs, aliases).

Everything is a pure ``DataFrame -> DataFrame`` function.  The ``llm`` subpackage is optional: nothing outside
it imports it, and it can be removed.
"""
