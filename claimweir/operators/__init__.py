"""DataFrame-level operators, one module per stage of the claims pipeline."""
