"""The SQL front end, the query catalogue and the logic-test runner."""
