"""Column-level functions (text) and pluggable model contracts."""
