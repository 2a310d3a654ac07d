"""wayfold: mobility-flow analytics expressed as Spark DataFrame operators."""
