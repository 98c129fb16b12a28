"""Set-based audit operators: reconcile, frontiers, history, health."""
