"""Document-extraction analytics on Spark: tables of text regions in, typed and scored records out."""
