"""docket: ingestion of incident records on Spark, as lazy DataFrame functions."""
