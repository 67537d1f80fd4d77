"""Search and detection over event streams, an extension of the batch engine."""
