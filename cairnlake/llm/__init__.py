"""Training-data operators: ten large-scale corpus operations and the queries that apply them.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; ``queries`` binds them to the tables of a data directory.
"""
