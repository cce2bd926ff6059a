"""rollkeep: a PySpark library that turns documents into a searchable register."""
