"""Multi-step jobs: partition search, tree training, fit-and-evaluate."""
