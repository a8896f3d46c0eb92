"""Query strings, formulas, times and durations."""
