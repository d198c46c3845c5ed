"""operators of the amalgam engine."""
