"""Reading result envelopes, reading and writing article store snapshots."""
