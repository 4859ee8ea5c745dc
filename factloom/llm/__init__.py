"""Training-data operators.  Nothing else in factloom imports this package."""
