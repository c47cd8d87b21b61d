"""Retail analytics on Spark: raw loads, marts, alert rules, stock, billing, retrieval, ledger."""
