"""The analysis as stages, the registered queries and their SQL oracles."""
