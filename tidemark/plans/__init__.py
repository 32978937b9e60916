"""Package tidemark.plans."""
