"""Questions and ranked retrieval."""
