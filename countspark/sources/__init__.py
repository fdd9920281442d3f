"""Reading, writing, checking and generating records."""
