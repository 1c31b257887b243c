"""Spark jobs that turn raw usage logs into one de-duplicated, priced token ledger and its reports."""
