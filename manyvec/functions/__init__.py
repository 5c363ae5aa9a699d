"""Column functions: vectors, masks, grids, strings."""
