"""hushql: anonymous answers to analytic queries over personal data, on Spark."""
