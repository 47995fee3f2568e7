"""tessera: a collection engine whose every operator is a Spark DataFrame plan."""
