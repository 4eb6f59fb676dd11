"""kindred: similarity search and near-duplicate detection on Spark."""
