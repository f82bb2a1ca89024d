"""The same rules on a growing verdict log or work list, as Structured Streaming jobs."""
