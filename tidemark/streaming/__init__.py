"""Package tidemark.streaming."""
