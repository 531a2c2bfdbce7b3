"""Survey-catalog analytics as lazy DataFrame operators."""
