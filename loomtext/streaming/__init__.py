"""streaming of loomtext."""
