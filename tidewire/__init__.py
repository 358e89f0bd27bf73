"""A PySpark-native news-intelligence engine.

``functions``: column functions; ``operators``: frames in, frames out;
``sources``: readers, writers and the views over the test tables; ``plans``:
registered queries with their SQL, and the facade; ``streaming``: micro-batches.
"""
