"""Column helpers and skew-safe ordered primitives shared by the operators."""
