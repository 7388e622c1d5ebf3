"""Where request rows come from and go to."""
