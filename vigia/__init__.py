"""Equipment-risk analytics as plain DataFrame functions on Spark SQL."""
