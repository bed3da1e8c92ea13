"""Running the row-at-a-time operators on streams of files."""
