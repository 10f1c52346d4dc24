"""docsift: document-sensitivity and corpus-preparation operators on PySpark DataFrames."""
