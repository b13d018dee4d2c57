"""litspark: document and bibliography analytics as Spark DataFrame jobs."""
