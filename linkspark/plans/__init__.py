"""Plan building blocks: staging, skew handling, end-to-end linkage plans."""
