"""Evidence analytics on PySpark: documents to chunks, facts, graph, retrieval and quality reports."""
