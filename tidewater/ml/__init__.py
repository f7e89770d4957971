"""Feature assembly, reduction, selection, models, tuning and evaluation on Spark ML."""
