"""Registered queries with their DuckDB SQL, the SQL generators, and the experiment."""
