"""Table readers, persisted artefacts and their fingerprints."""
