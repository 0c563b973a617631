"""DataFrame-to-DataFrame steps: normalising, selecting, scoring, ranking, merging."""
