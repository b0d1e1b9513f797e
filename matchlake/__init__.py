"""League analytics on Spark: cleaning, features, models and forecasts as DataFrame jobs."""
