"""Where documents, references and snapshots come from."""
