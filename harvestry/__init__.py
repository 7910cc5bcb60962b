"""Frequent itemsets, association rules and stream drift detection as DataFrame programs."""
