"""Training-data operators: mixing, quality, privacy, toxicity, deduplication, decontamination, scoring."""
