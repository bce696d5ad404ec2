"""Reusable plan shapes: ordered totals, time joins, nearest neighbours, salted joins."""
