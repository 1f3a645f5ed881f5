"""Logical plans: immutable nodes with a fluent builder."""

from .nodes import Aggregate, Distinct, Exists, Filter, Join, Limit, Mark, Plan, Project, Scan, SetOp, Sort, Window, scan

__all__ = ["Aggregate", "Distinct", "Exists", "Filter", "Join", "Limit", "Mark", "Plan", "Project", "Scan", "SetOp", "Sort", "Window", "scan"]
