"""DataFrame-in, DataFrame-out operators on the schemas of orbtable.schema."""
