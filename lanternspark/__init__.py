"""Grounded retrieval and question answering over text, declared as Spark DataFrame plans."""
