"""Whole forecasting jobs, from prices to forecasts."""
