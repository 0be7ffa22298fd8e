"""Operations of a training-data pipeline over text tables.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; :mod:`tracewright.llm.queries` has the thin queries.
"""
