"""Speech-transcript analytics as PySpark DataFrame operators."""
