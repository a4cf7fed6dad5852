"""Column -> Column functions; all of them stay inside the JVM unless the name ends in ``_udf``."""
