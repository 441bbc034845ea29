"""Registered queries: each module offers QUERIES (name -> callable) and ORACLE (name -> SQL)."""

CORE_MODULES = ["lexical_queries", "result_queries", "judge_queries", "study_queries", "stream_queries", "wide_queries", "source_queries"]
