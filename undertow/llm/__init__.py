"""Training-data operators: cleaning, deduplication, tokenization and packing of documents."""
