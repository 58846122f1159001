"""Customer-journey and repayment analytics as Spark DataFrame functions."""
