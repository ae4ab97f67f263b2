"""Geometry analytics and corpus operators written as Spark DataFrame plans."""
