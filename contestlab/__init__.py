"""contestlab: forecasting and evaluation of paired contests as Spark DataFrame operators."""
