"""folioscope: scholarly-output analytics expressed as Spark DataFrame plans."""
