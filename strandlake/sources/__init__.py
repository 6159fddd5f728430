"""sources of the sample-comparison engine."""
