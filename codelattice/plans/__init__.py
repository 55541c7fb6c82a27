"""Registered queries and plan builders."""
