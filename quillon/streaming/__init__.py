"""Windows over streams and online clustering of what they hold."""
