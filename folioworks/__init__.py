"""folioworks: document-corpus analytics written as Spark DataFrame plans."""
