"""Forecasting models, composed of operators."""
