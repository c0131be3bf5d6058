"""Column functions and the small per-row page helpers."""
