"""corpusveil: PII detection, redaction and reporting over document corpora, on Spark."""
