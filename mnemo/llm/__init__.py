"""Training-data pipeline operators: quality, secrets, mixing, dedup, toxicity, token storage, search, licences, decontamination."""
