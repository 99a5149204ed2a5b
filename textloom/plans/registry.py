"""All queries of the library, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from textloom.operators import evidence, families, graph, history, inference, overlap, policy, project, rule_cases, rules, scoring, text_stats

MODULES = (text_stats, overlap, rules, scoring, history, graph, inference, families, rule_cases, policy, project, evidence)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
