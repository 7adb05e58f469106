"""Column-level building blocks: money, calendar periods, payroll rules."""
