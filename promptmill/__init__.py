"""Prompt evaluation and improvement over large tables of model outputs, on Spark."""
