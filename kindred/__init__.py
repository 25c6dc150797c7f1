"""Near-duplicate analytics over large catalogues, written as Spark DataFrame plans."""
