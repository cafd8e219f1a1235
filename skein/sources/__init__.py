"""Where sources and bindings come from."""
