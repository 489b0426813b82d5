"""Training-data operators: cleaning, de-duplication, packing and encoding of text corpora."""
