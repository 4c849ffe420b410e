"""Derived graph tables, the discovery plan and the registered queries."""
