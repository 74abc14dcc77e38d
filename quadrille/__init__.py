"""RDF datasets and graph queries on Spark."""
