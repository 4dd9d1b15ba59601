"""Session-trace analytics on Spark: sources, tree toolkit, pricing, waste rules, roll-ups."""
