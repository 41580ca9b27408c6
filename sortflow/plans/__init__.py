"""Plan shapes shared by the operators: bounded broadcasts, chunked scans, hash quotas, scratch tables."""
