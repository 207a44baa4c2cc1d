"""Column expressions and driver-side encoders."""
