"""Where results go: control records and replies, shipped messages, reports."""
