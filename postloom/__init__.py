"""Job-posting extraction, normalisation, quality and tracking as Spark DataFrame operators."""
