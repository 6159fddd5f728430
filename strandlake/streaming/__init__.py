"""streaming of the sample-comparison engine."""
