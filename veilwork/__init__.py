"""Text safety for Spark tables and streams: find and mask personal data,
score prompt injection, route rows and report on them."""
