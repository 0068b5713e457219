"""Training-data operators: dedup, language ID, packing, search and encoding.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries and the SQL that ``__spark_entry__`` adds.
"""
