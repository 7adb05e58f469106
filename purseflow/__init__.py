"""purseflow: ledger, budget, payroll and exchange-rate analytics as Spark DataFrame functions.

Every public function takes DataFrames and returns DataFrames, keyed by ``user_id``, so one
job answers a report for all users; filter on ``user_id`` for a single one.
"""
