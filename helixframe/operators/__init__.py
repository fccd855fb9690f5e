"""DataFrame to DataFrame steps. They are lazy unless their docstring names an action."""
