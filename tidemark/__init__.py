"""tidemark: a PySpark-native engine for forecast panels, market lines and the data around them."""

__version__ = "0.1.0"
