"""Relational risk-feature engineering, signal measurement and model evaluation on Spark."""
