"""A citable document-library analytics engine on Apache Spark."""
