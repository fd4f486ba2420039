"""Set-oriented memory engine on PySpark: recall, graph impact, feedback, consolidation."""

__version__ = "0.1.0"
