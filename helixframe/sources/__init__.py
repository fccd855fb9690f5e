"""Reading and writing. Writers are actions."""
