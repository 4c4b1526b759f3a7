"""Readers and writers: task logs, protocol messages, quota windows, webhooks."""
