"""Training-data operators.

Nothing outside this subpackage imports it.  ``registry`` lists the queries and
their SQL; ``corpus_pipeline.py`` at the repository top chains the operators.
"""
