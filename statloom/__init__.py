"""Store, search and analyse genome-wide association summary statistics with Spark."""
