"""Where to resume, what that would cost, and the scenario catalogue."""
