"""sources of the amalgam engine."""
