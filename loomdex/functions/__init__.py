"""loomdex.functions."""
