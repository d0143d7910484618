"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``tidewake.llm.queries`` registers
its queries.  Each module holds one operator with its general interface.
"""
