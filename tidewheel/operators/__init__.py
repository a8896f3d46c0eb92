"""Aggregations, anomaly detection, forecasting, catalog and maintenance."""
