"""Readers: each returns good rows and, where input can be bad, the bad ones with a reason."""
