"""Spark-first analytics for part assemblies, with a training-data toolbox in ``partloom.llm``."""
