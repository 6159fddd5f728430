"""plans of the sample-comparison engine."""
