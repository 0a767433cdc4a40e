"""jobs of loomtext."""
