"""Reading experiment logs and dimensions, and writing result tables."""
