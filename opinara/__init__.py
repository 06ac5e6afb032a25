"""Opinion-text analytics as Spark DataFrame transforms and Column functions."""
