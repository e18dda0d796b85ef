"""Dataframe verbs and analytical operators for exploratory data studies, as Spark plans."""

__version__ = "0.1.0"
