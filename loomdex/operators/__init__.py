"""loomdex.operators."""
