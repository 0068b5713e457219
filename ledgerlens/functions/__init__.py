"""Column builders: no actions, no Python on the executors unless a name says so."""
