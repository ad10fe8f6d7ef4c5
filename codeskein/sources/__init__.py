"""Where files and changes come from."""
