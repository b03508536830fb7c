"""Tables read from source trees, logs and events."""
