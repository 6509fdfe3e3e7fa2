"""Row numbering, blocks, frames, folds, splits and metrics over long price tables."""
