"""langdrift: PySpark jobs that measure how language changes over time and between groups."""
