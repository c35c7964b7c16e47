"""Training-data operators over large text corpora.

Nothing outside this subpackage imports it.  ``queries`` lists the query
callables that ``__spark_entry__`` publishes when the subpackage is present.
"""
