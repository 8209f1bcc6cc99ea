"""DataFrame-to-DataFrame operators. All of them are lazy unless their docstring says otherwise."""
