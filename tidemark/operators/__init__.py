"""Package tidemark.operators."""
