"""Operators on program text: flow graphs and taint over Python sources."""
