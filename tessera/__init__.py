"""A PySpark analytics engine for star-schema workloads."""
