"""Event time-series analytics on Spark: spike trains aligned to stimuli, and what is computed from them."""
