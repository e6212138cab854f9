"""A PySpark analytics and forecasting engine for bar data."""
