"""operators of loomtext."""
