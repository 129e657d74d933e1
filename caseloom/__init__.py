"""caseloom: corpus investigation analytics expressed as Spark jobs."""
