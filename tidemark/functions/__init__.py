"""Column expressions; every one of them stays inside Catalyst."""
