"""streaming of the amalgam engine."""
