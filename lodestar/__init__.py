"""lodestar."""
