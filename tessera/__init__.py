"""tessera: a relational and corpus-processing engine written in idiomatic PySpark."""
