"""Column expressions: cleaning, returns, mergeable summaries, normal equations."""
