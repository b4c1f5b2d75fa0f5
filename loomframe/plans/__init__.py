"""Plans of loomframe."""
