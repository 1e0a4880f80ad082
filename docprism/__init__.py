"""docprism: document-integrity analytics expressed as Spark plans."""
