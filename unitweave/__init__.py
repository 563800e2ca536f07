"""A Spark-first engine that turns free-text organisation strings into a catalogue of sub-units."""
