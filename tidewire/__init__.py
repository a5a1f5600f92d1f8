"""Message-feed analytics as PySpark DataFrame operators."""
