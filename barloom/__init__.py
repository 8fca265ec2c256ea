"""Market-data and trading-records analytics as Spark DataFrame operators."""
