"""Price-benchmark engine on Spark: quotes in, auditable fixings out."""
