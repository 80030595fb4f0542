"""Association-rule analytics as PySpark DataFrame transformations."""
