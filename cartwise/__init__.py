"""Retail analytics on Spark: load, dashboard, household pull, basket mining, churn."""
