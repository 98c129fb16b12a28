"""Column-level work: wire format, routes, validity rules, clocks."""
