"""Training-data operators.

Nothing outside this subpackage imports it. Modules are imported where they
are used, so that a Python worker loads only what its operator needs.
"""
