"""oppengine: opportunity-record queries as PySpark DataFrame operators."""
