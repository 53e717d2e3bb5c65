"""Entity-level risk analytics as Spark jobs.

Ranking, comparison, trend and period-change queries over an entity x year mart
and an entity x category x year event table; feature building, training, scoring
and drift monitoring; document chunking and vector retrieval; question-log
tagging and answer scoring.  Every operator takes DataFrames and returns a
DataFrame.
"""
