"""File events: cleaning, debouncing and applying them as a stream."""
