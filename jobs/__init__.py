"""Jobs that run from a command line; each keeps its work in a function that takes a session."""
