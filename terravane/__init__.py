"""terravane: a Spark-first engine for gridded, vector and text data."""
