"""Stream-delivery audit and recovery as Spark DataFrame operators."""
