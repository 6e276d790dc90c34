"""Training-data operators: extraction, filtering, deduplication, scoring, packing and token files.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface, the thin query that ``__spark_entry__`` registers for it, and (where SQL can express the
query) its DuckDB text.
"""
