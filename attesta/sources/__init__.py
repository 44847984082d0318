"""Where rows come from: the event log, text evidence, adapters for plain tables."""
