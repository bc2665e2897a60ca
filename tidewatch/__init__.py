"""Model-drift monitoring expressed as Spark DataFrame operators and streams."""
