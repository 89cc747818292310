"""SQL statements of the same results, for the correctness check in another engine."""
