"""A PySpark library for investigating large event logs."""
