"""Operators for preparing training corpora, one module per operator.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries only when it can be imported.
"""
