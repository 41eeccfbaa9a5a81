"""An engine for evidence over package inventories, and for policy verdicts drawn from it, on Spark."""
