"""A PySpark engine that collects, enriches, merges and searches job postings as DataFrame transforms."""
