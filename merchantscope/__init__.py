"""Card-merchant integrity analytics as PySpark DataFrame jobs."""
