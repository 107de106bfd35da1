"""Content-store analytics on Spark."""
