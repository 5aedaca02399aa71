"""DataFrame-in, DataFrame-out operators, one module per stage of a habitat model."""
