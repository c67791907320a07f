"""Entity search and intelligence analytics as DataFrame operators on Spark."""
