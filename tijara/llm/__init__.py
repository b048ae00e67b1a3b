"""Training-data operators: thirteen document-scale Spark jobs and their queries.

Nothing outside this subpackage imports it.
"""
