"""lexarbor: collocation analytics over dependency-parsed corpora, on Spark DataFrames."""
