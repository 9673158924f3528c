"""Training-data operators: ten self-contained operators over large document tables."""
