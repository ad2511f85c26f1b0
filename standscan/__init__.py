"""standscan: point-cloud and corpus analytics written as Spark DataFrame jobs."""
