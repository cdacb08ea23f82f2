"""Market-news and capital-flow analytics as Spark DataFrame operators."""
