"""driftline: document-difference analytics as Spark DataFrame plans."""
