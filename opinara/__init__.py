"""Opinion analytics as lazy PySpark DataFrame plans."""
