"""factloom: auditable fact analytics as PySpark plans."""
