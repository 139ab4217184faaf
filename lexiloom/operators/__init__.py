"""Table operators. Fitted state is bounded; ``transform`` never shuffles the wide table."""
