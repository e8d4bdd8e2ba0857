"""mnemoframe: a conversation-memory engine written as Spark DataFrame jobs."""
