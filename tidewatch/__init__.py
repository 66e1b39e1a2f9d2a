"""Early-window event features, scoring and evaluation as Spark DataFrame operators."""
