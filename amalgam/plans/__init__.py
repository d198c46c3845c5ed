"""plans of the amalgam engine."""
