from tillroll.plans import q_candidates, q_eda, q_features, q_metrics, q_rules, q_tables  # noqa: F401
from tillroll.plans.registry import oracle_queries, spark_queries  # noqa: F401
