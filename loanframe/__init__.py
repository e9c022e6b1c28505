"""Credit-risk analytics over statements, applications and loan history, as Spark jobs."""
