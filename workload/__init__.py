"""The registered queries: what each runs on Spark, and the SQL it has to agree with."""
