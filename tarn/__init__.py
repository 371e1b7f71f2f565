"""tarn: curated, federated full-text search analytics as Spark plans."""
