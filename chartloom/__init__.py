"""Chart-series analytics on Spark: detections, label readings and traced lines as DataFrames."""
