"""Rule-driven document analytics on Spark."""
