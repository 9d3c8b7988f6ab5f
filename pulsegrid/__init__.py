"""Event-train and trial-structured analytics as Spark DataFrame operators."""
