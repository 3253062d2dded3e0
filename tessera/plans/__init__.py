"""Query plans: the shared fixture derivations, the query catalog and its SQL oracle."""
