"""Evidentia: evidence analytics over fact tables, written as Spark DataFrame transforms."""
