"""Operators: each takes a DataFrame of incidents (or tickets) and returns one."""
