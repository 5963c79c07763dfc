"""tessera: entity resolution, indicators and training-data operators on PySpark DataFrames."""
