"""Readers, writers and the test-table binding of the order-line fact."""
