"""Review actions as a stream."""
