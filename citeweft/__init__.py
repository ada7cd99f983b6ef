"""Citation-chasing analytics on Spark: expansion, entity resolution, ranking, estimation and stopping rules."""
