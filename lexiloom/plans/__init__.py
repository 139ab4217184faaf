"""Feature stages, classifiers, and the ways to fit, score and tune them."""
