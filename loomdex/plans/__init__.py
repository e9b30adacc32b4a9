"""loomdex.plans."""
