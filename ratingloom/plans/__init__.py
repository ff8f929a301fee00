"""Registered queries: each an operator over the fixture, with DuckDB SQL where SQL can express it."""
