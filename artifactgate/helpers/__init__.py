"""Small vectorised functions for what no built-in expresses."""
