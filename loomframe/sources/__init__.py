"""Sources of loomframe."""
