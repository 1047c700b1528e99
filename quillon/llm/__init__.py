"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface; ``registry`` holds the thin ``opN_`` queries.
"""
