"""DataFrame-to-DataFrame steps: encoding, scaling, cuts, statistics, splits, scoring, reports."""
