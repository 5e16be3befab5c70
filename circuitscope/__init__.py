"""Circuit-to-device analytics on Spark: scans, joins, rankings, exports and validation as DataFrames."""
