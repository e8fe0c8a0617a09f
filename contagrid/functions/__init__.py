"""Scalar expressions: every function maps Columns to a Column, JVM-side."""
