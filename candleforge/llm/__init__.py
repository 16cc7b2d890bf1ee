"""Operations of a large-scale training-data pipeline over ``documents`` and friends.

Nothing outside this subpackage imports it; the queries are registered by
:mod:`candleforge.llm.queries` and the whole folder can be removed.
"""
