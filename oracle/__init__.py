"""Registered queries over the driver's tables and the DuckDB SQL they must equal."""
