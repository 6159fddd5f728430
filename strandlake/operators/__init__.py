"""operators of the sample-comparison engine."""
