"""mailglass: set-at-a-time e-mail threat analytics on PySpark."""

__version__ = "0.1.0"
