"""DuckDB SQL that each registered query must agree with, on the same test tables."""
