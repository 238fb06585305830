"""tastemill: preference analytics over large interaction logs, expressed as Spark DataFrame plans."""
