"""Relational operators: windows over series, point-in-time joins, folds, statistics, resampling, models, audits."""
