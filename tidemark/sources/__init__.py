"""Package tidemark.sources."""
