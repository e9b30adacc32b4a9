"""loomdex.sources."""
