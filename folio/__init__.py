"""Folio: documentation-corpus analytics expressed as Spark DataFrame plans."""
