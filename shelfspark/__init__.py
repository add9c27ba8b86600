"""shelfspark: search, cleaning and audit of a digital library, written as Spark plans."""
