"""Operators for training corpora: packing, near-duplicates, formatting, sketches, filters and mixing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
