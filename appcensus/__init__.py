"""Application census of a fleet of hosts, written as Spark DataFrame jobs."""
