"""functions of the sample-comparison engine."""
