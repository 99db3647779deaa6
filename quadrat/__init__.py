"""Test-set quality analytics and training-data operators on Spark."""
