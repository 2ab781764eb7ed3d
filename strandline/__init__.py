"""Document lineage on Spark: who derives from whom, and how well a method says so."""
