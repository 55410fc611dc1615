"""Panel (symbol x date) analytics expressed as Spark DataFrame operators."""
