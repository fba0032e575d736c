"""Set-based operators: every function takes and returns DataFrames keyed by run, index and version."""
