"""Operations of a training-data pipeline: dedup, quality, mixing, redaction, search, archives."""
