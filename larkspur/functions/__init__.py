"""Scalar rules: each takes Columns and returns a Column built from JVM expressions."""
