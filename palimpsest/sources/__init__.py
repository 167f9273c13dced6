"""The durable store: manifest, runs, transactions."""
