"""Package tidemark.functions."""
