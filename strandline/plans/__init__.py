"""The registered queries, each beside the SQL that states the same result; importing the package registers them all."""

from strandline.plans import code_queries, judging_queries, record_queries, rule_queries, site_queries, text_queries

__all__ = ["code_queries", "judging_queries", "record_queries", "rule_queries", "site_queries", "text_queries"]
