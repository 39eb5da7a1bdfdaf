"""Agent-log analytics and corpus operators expressed as Spark jobs."""
