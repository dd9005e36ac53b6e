"""corpusloom: preparing, indexing, searching and auditing text corpora on Spark."""
