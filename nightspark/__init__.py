"""nightspark: Spark DataFrame operators for overnight 1 Hz recordings."""
