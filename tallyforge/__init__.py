"""Usage-metering analytics and data processing on Spark."""
