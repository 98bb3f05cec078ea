"""Plan shapes shared by the operators: hot-key splitting, ranking, lineage."""
