"""Web-traffic, settings and certificate-ledger work as plain Spark DataFrame functions."""
