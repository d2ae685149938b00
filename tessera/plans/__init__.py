"""Physical-plan helpers and end-to-end jobs composed from operators."""
