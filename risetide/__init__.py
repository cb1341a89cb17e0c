"""risetide: social and news trend analytics as PySpark DataFrame jobs."""
