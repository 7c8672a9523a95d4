"""leafloom: knowledge-tree corpus jobs expressed as Spark DataFrame transformations."""
