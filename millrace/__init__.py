"""millrace: lazily evaluated distributed collections and data-preparation operators on Spark DataFrames."""
