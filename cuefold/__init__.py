"""cuefold: timed-text and evidence analytics as ordinary Spark DataFrame transforms."""
