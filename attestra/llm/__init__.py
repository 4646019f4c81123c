"""Training-data operators: scoring, deduplication, decontamination, extraction, tokenisation."""
