"""Set-based Spark jobs for evidence-backed prospecting."""
