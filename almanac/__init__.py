"""Statistical analysis of entity histories on Spark DataFrames.

An entity (player, customer, account) has one row per period. The package reads such
tables, adjusts them against their period, rolls them up to careers, fills gaps, projects
unfinished careers, predicts outcomes and scores the resulting rankings.
"""
