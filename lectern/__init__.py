"""A PySpark library that turns semi-structured documents into validated question records, selects,
grades and summarises them, and (in a separate subpackage) prepares training data."""
