"""mapquarry: spatial dataset discovery expressed as Spark DataFrame plans."""
