"""tillframe: retail order-line reports and sales forecasting as PySpark DataFrame functions."""
