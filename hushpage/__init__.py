"""Page-privacy analytics on Spark: detection, fusion, redaction, verification and planning as DataFrame transforms."""
