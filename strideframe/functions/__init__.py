"""Column functions: text keys, scores, distribution tails."""
