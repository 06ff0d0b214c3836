"""Named queries over the test tables, and the command line."""
