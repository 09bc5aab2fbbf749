"""Trip, sales and review analytics as plain PySpark DataFrame operators."""
