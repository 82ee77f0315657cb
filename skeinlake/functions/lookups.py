"""Constant tables of the rules, as column expressions: they are small and fixed, so they stay in the projection and need no join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "java": "java", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp"}
WIDE_LANGUAGES = {**LANGUAGES, "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "shell", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml"}
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml")
EDGE_FACTORS = {"Calls": 0.9, "Inherits": 0.95, "Implements": 0.9, "Uses": 0.7, "References": 0.6, "Imports": 0.5, "Contains": 0.8, "DependsOn": 0.8, "Exports": 0.3}
NO_EDGE_FACTOR = 0.4
TYPE_FACTORS = {"Function": 1.0, "Class": 1.2, "Module": 1.1, "File": 0.8}
CHANGE_RISK = {"FunctionRemoved": "Critical", "InterfaceChanged": "Critical", "FunctionSignatureChanged": "High", "ParameterCountChanged": "High", "ReturnTypeChanged": "High", "VisibilityChanged": "High", "StructureChanged": "Medium", "ModuleStructureChanged": "Medium", "FunctionAdded": "Low"}
CHANGE_IMPACT = {"FunctionRemoved": "Project", "InterfaceChanged": "Project", "FunctionSignatureChanged": "Module", "ParameterCountChanged": "Module", "ReturnTypeChanged": "Module", "VisibilityChanged": "Local", "StructureChanged": "Local", "FunctionAdded": "Minimal", "ModuleStructureChanged": "Minimal"}
RISK_RANK = {"None": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
RISK_SCORE = {"Critical": (90, 10), "High": (70, 8), "Medium": (40, 5), "Low": (15, 2)}
SCANNER_TO_REVIEW = {"ERROR": "Error", "WARNING": "Warning", "INFO": "Info"}
REVIEW_TO_TOOL = {"Critical": "critical", "High": "high", "Error": "high", "Medium": "medium", "Warning": "medium", "Low": "low", "Info": "info"}


def case(value: Column, table: Mapping, default=None) -> Column:
    """table[value], or the default."""
    out = None
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)) if out is None else out.when(value == key, F.lit(to))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def sql_case(value: str, table: Mapping, default: str = "NULL") -> str:
    """The same for SQL text."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"CASE {value} {' '.join(f'WHEN {show(k)} THEN {show(v)}' for k, v in table.items())} ELSE {default} END"


def extension(path: Column) -> Column:
    """Lower-cased extension of a path's last component; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
