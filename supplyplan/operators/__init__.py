"""User-facing operators, one module per area."""
