"""DataFrame-to-DataFrame operators over task logs, task state and messages."""
