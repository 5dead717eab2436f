"""cardloom - a PySpark engine that turns documents into chunks and question-answer cards and analyses them."""

__version__ = "0.1.0"
