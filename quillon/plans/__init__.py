"""What is compiled into Catalyst plans: constraint strings and index definitions."""
