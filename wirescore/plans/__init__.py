"""Query catalogue: thin queries over the operators, with their SQL twins."""
