"""chronoframe: versioned, transactional key-value analytics as Spark plans."""
