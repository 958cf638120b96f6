"""Operations for training-data pipelines: near-duplicates, quality, URLs, tokens, spans, extraction, lines, leaks, personal data."""
