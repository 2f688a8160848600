"""Complete runs made of the operators."""
