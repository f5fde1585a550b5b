"""Where records, rules, policies and snapshots come from."""
