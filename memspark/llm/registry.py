"""Queries of the llm subpackage."""

from memspark.llm import q_languages, q_leaks, q_mixing, q_names, q_near_duplicates, q_pairs, q_pii

_MODULES = [q_names, q_near_duplicates, q_pairs, q_pii, q_leaks, q_mixing, q_languages]
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
