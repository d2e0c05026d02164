"""quillmill: DataFrame-in, DataFrame-out operators for document, bibliography, OCR, graph and signal data."""

__version__ = "0.1.0"
