"""functions of the amalgam engine."""
