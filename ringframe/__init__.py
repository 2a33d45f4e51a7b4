"""ringframe: measurements taken around regularly spaced objects, as Spark DataFrame queries."""
