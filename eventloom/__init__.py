"""Event analysis on Spark: selections, corrections, histograms and scores
for tables whose rows are events with nested collections of objects."""
