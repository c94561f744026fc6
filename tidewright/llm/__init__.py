"""Operators for preparing training corpora: token counts and ids, packing, deduplication, classifiers, search.

Nothing outside this subpackage imports it; it can be deleted and the rest of the library still works.
"""
