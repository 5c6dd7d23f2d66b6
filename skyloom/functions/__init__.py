"""Column expressions and small driver-side maths."""
