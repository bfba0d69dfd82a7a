"""Where tapes come from and where results go."""
