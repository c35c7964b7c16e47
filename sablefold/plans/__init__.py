"""Policies and the plan that they select."""
