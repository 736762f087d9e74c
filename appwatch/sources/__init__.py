"""Where rows come from and go to: batch documents, topics, tables, metadata."""
