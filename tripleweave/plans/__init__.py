"""Graph patterns and the choice of the table each one reads."""
