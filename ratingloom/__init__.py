"""ratingloom: point-in-time ratings and tournament forecasts on Spark DataFrames."""
