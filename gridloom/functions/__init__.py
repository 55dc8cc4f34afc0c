"""Column functions: pure expressions that Catalyst can fold, push down and compile."""
