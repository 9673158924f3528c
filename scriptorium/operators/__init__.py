"""DataFrame operators: glossary, segmentation, abbreviations, timelines, audits, feed, cache."""
