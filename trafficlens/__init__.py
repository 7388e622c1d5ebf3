"""Web-traffic session analytics on Spark: requests in, features, scores and actions out."""
