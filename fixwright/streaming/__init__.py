"""The daily job run incrementally."""
