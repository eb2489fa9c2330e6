"""tagsieve: catalog and tag analytics expressed as Spark DataFrame plans."""
