"""Column functions: text to tokens, token filters, scores, spans, distances, dates, sort keys."""
