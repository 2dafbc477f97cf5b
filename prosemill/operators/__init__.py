"""Table operators: segmentation, statistics, comparison, rules."""
