"""Glass-box models fitted on Spark: penalised logistic regression and additive boosting."""
