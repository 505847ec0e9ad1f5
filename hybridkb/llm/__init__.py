"""Training-data operators: filtering, deduplication, decontamination, search, extraction and tokenising."""
