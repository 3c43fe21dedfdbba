"""quillon: listing analytics and training-data operators as PySpark DataFrame jobs."""
