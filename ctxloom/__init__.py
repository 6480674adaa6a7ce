"""Context working-set engine on PySpark."""
