"""Order files to a checked star schema, as Spark DataFrame functions."""
