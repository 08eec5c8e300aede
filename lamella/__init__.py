"""lamella: detection-and-annotation analytics as PySpark DataFrame operators."""
