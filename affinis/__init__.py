"""affinis: record linkage and data processing as PySpark DataFrame plans."""
