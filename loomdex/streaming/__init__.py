"""loomdex.streaming."""
