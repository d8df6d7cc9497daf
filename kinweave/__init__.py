"""Record linkage and corpus preparation as Spark plans."""
