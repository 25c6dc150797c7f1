"""Relational operators: joins, kernels, grouping, ranking, statistics, selection, sorting."""
