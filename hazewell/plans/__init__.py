"""Every operator as a query over the given tables, beside the SQL that checks it."""

from hazewell.plans import (  # noqa: F401
    agg_queries,
    alert_queries,
    calibrate_queries,
    clean_queries,
    evaluate_queries,
    explain_queries,
    forecast_queries,
    join_queries,
    pipeline_queries,
    quality_queries,
    rule_queries,
    scalar_queries,
    select_queries,
    source_queries,
    stream_queries,
    window_queries,
)
from hazewell.plans.registry import QUERIES, oracle_text, runnable  # noqa: F401
