"""Training-data operators: ten cleaning, dedup, scoring and packing steps over `documents`/`embeddings`.

Nothing outside this subpackage imports it.
"""
