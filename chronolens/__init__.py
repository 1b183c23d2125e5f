"""Analytics over event timelines on Spark: work days, activities, contexts, rhythm, search, redaction, evaluation."""
